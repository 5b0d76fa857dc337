import re
from collections import Counter

import numpy as np
from tests.llm.cases import awkward, documents

from tarnlake.llm.near_dedup import bands, block_links, components, dart_signatures, expanded, links_of, near_classes


def shingles(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    return Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else Counter([tuple(ws)] if ws else [])


def brute(rows, threshold=0.8):
    keys = [tuple(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows]
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for members in holders.values():
        for j in members:
            for i in members:
                if i < j and (i, j) not in seen and find(i) != find(j):
                    seen.add((i, j))
                    both = sum((sets[i] & sets[j]).values())
                    if both >= threshold * sum((sets[i] | sets[j]).values()):
                        parent[find(i)] = find(j)
    same = {}
    for i, k in enumerate(keys):
        if k in same:
            parent[find(i)] = find(same[k])
        same[k] = i
    low, size = {}, Counter()
    for i, r in enumerate(rows):
        c = find(i)
        size[c] += 1
        low[c] = min(low.get(c, (r.doc_id is None, r.doc_id or 0)), (r.doc_id is None, r.doc_id or 0))
    ids = {c: None if none else i for c, (none, i) in low.items()}
    return sorted((str(r.doc_id), str(ids[find(i)]), size[find(i)], ids[find(i)] == r.doc_id) for i, r in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in df.collect())


def test_against_brute_force(spark, sf_small):
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        assert result(near_classes(docs)) == brute(docs.collect())


def test_chain_and_large_group(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(300)]
    rows, chain = [], list(base)
    for i in range(12):  # each differs from the one before in a few places, the ends differ in many
        rows.append((i, " ".join(chain)))
        for j in rng.choice(300, 4, replace=False):
            chain[j] = f"new{i}x{j}"
    other = [f"v{i}" for i in range(200)]
    for i in range(100, 220):
        edited = list(other)
        edited[rng.integers(200)] = f"e{i}"
        rows.append((i, " ".join(edited)))
    docs = documents(spark, rows)
    assert result(near_classes(docs)) == brute(docs.collect())


def test_empty(spark):
    assert near_classes(documents(spark, [])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for n, share in ((3, 0.6), (60, 0.8), (3000, 0.5)):
        value = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        weight = rng.integers(1, 5, 2 * n).astype(float)
        a = weight.copy()
        b = np.where(rng.random(2 * n) < share, weight, weight * 0.5)
        owner = np.repeat([0, 1], 2 * n)
        signatures = dart_signatures(owner, np.tile(value, 2), np.concatenate([a, b]), 2, 2000)
        truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((signatures[0] == signatures[1]).mean() - truth) < 0.05
    alone = dart_signatures(np.array([1]), np.array([7], np.uint64), np.array([1.0]), 3, 50)
    assert (alone[0] == alone[2]).all() and (alone[1] != alone[0]).all() and bands(alone).shape == (3, 10)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)] + [(200, i) for i in range(201, 260)]
    df = spark.createDataFrame([(b"%04d" % a, b"%04d" % b) for a, b in links], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in components(df, "test-components").collect()}
    assert len(got) == 41 + 3 + 60 and set(got.values()) == {b"0000", b"0100", b"0200"}


def test_links_equal_all_pairs(spark):
    """Buckets in which the lead is alike few others, in one block and in many."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    sets, families = [], [rng.integers(0, 1 << 62, 30).astype(np.uint64) for _ in range(6)]
    for i in range(150):
        keep = base[rng.random(120) > rng.uniform(0, 0.2)]
        own = rng.integers(0, 1 << 62, rng.integers(0, 15)).astype(np.uint64)
        more = families[i % 6][rng.random(30) > 0.1] if i % 3 == 0 else own
        sets.append(expanded(np.unique(np.concatenate([keep, more])), np.ones(len(np.unique(np.concatenate([keep, more]))))))
    parent = list(range(150))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(150):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(150):
        groups.setdefault(find(i), set()).add(i)
    want = sorted(map(sorted, groups.values()))
    assert 1 < len(want) < 150
    elements = spark.createDataFrame([(b"%03d" % i, s.tobytes()) for i, s in enumerate(sets)], "node binary, elements binary")
    members = spark.createDataFrame([(bucket, b"%03d" % i, len(sets[i])) for bucket in (1, 2) for i in range(150)], "bucket bigint, node binary, size bigint")
    for block in (256, 20):
        labels = {int(r.node): int(r.label) for r in links_of(members, elements, 0.8, block).collect()}
        got = {}
        for i in range(150):
            got.setdefault(labels.get(i, i), set()).add(i)
        assert sorted(map(sorted, got.values())) == want


def test_block_links_across_sides():
    a = np.arange(10, dtype=np.uint64)
    sets = [a, a, a + np.uint64(1), a + np.uint64(100)]
    assert block_links(sets, [0, 1, 2, 3], np.zeros(4, bool), 0.8) == [(0, 1), (0, 2)]
    assert block_links(sets, [0, 0, 2, 3], np.array([False, False, True, True]), 0.8) == [(0, 2)]
    assert block_links([], [], np.zeros(0, bool), 0.8) == []


def test_recall_of_planted_edits(spark):
    """250 pairs in each band of similarity, of short and long texts with words replaced, dropped and added: nearly all are one class, and no pair is joined with another."""
    import random

    rng, levels = random.Random(77), [(0.8, 0.825), (0.825, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)]
    words = [f"{a}{b}" for a in ("thr", "and", "onl", "ver", "est") for b in range(400)]
    pairs = {level: [] for level in levels}
    rows = []
    while any(len(p) < 250 for p in pairs.values()):
        one = rng.choices(words, k=rng.choice([60, 120, 300, 800]))
        two = list(one)
        for _ in range(max(1, int(len(one) * rng.uniform(0, 0.035)))):
            i = rng.randrange(len(two))
            two[i : i + 1] = rng.choice([[f"new{rng.random()}"], [], [two[i], f"add{rng.random()}"]])
        a, b = shingles(" ".join(one)), shingles(" ".join(two))
        likeness = sum((a & b).values()) / sum((a | b).values())
        level = next((x for x in levels if x[0] <= likeness < x[1]), None)
        if level and len(pairs[level]) < 250:
            pairs[level].append(len(rows))
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    found = {r.doc_id: (r.class_id, r.class_size) for r in near_classes(documents(spark, rows)).collect()}
    recall = {level: np.mean([found[i] == found[i + 1] == (i, 2) for i in own]) for level, own in pairs.items()}
    print(recall)
    assert all(x >= 0.99 for x in recall.values()), recall

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tests.llm.cases import awkward, documents

from tarnlake.llm.substring_dedup import path_lengths, substring_dedup, verified_paths
from tarnlake.llm.vec import Bits, rolling, sliding_argmin, text_bytes, word_hashes, words


def brute(rows, window):
    place = lambda i, s: (i is None, i or 0, s)
    split = [(r.doc_id, re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows]
    first = {}
    for i, ws in split:
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            first[key] = min(first.get(key, place(i, s)), place(i, s))
    out = []
    for i, ws in split:
        keep = [True] * len(ws)
        for s in range(len(ws) - window + 1):
            if place(i, s) > first[tuple(ws[s : s + window])]:
                keep[s : s + window] = [False] * window
        kept = [w for w, k in zip(ws, keep) if k]
        out.append((str(i), len(ws), len(ws) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_against_brute_force(spark, sf_small):
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        assert result(substring_dedup(docs, digests=True)) == brute(docs.collect(), 20)


def test_random_repeats_with_few_words(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(120)]
    docs = documents(spark, rows)
    assert result(substring_dedup(docs, window=6, k=3, digests=True)) == brute(docs.collect(), 6)


def test_more_nodes_than_the_sets_hold(spark, monkeypatch):
    """Sets of 64 bits say yes to everything: more rows are read, and the result is the same."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    rows = [(i, " ".join([" ".join(rng.choice(words, 30)), passages[int(rng.integers(40))], passages[int(rng.integers(40))][: int(rng.integers(50, 300))], " ".join(rng.choice(words, 30))])) for i in range(150)]
    docs = documents(spark, rows)
    want = brute(docs.collect(), 20)
    assert sum(r[2] for r in want) > 3000 and result(substring_dedup(docs, digests=True)) == want
    monkeypatch.setattr(Bits, "MOST", 6)
    monkeypatch.setattr(Bits, "LEAST", 6)
    assert result(substring_dedup(docs, digests=True)) == want


def test_paths_are_compacted_by_joins(spark):
    """Chains of 1, 2, 5 and 300 nodes, of one edge each, and a chain that leads into a branching node."""
    chains = [[1], [2, 3], [10, 11, 12, 13, 14], list(range(1000, 1300)), [50, 51]]
    after = {a: b for c in chains for a, b in zip(c, c[1:])} | {51: 99}
    nodes = spark.createDataFrame([(n, 2, after.get(n, 0), n % 7 + 1) for c in chains for n in c], "node bigint, n bigint, after bigint, windows bigint")
    got = {r.node: r.windows for r in path_lengths(nodes).collect()}
    assert got == {c[0]: sum(n % 7 + 1 for n in c) for c in chains}


def test_long_copies(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(words, 6000))
    docs = documents(spark, [(1, f"a {long} b"), (2, long), (3, f"{long} {long[: len(long) // 2]}"), (None, long), (5, " ".join(long.split()[100:4000]))])
    assert result(substring_dedup(docs, digests=True)) == brute(docs.collect(), 20)


def test_places_with_other_words_are_refused(spark):
    """Rows that claim to be one path, of which one has other words."""
    words = [f"w{i}" for i in range(40)]
    texts = [(1, 11, " ".join(words)), (2, 22, "a " + " ".join(words)), (3, 33, " ".join([*words[:30], "x", *words[31:]])), (None, 44, " ".join(words))]
    docs = spark.createDataFrame(texts, "doc_id bigint, uid bigint, text string")
    paths = spark.createDataFrame([(7, 1, 11, 0, 21), (7, 2, 22, 1, 21), (7, 3, 33, 0, 21), (7, None, 44, 0, 21), (9, 1, 11, 3, 21)], "node bigint, doc_id bigint, uid bigint, start bigint, windows bigint")
    got = sorted(map(tuple, verified_paths(docs, paths, 20).collect()), key=str)
    assert got == [(2, 22, 1, 41), (None, 44, 0, 40)]


def test_text_and_empty(spark):
    assert substring_dedup(documents(spark, [])).count() == 0
    line = " ".join(f"w{i}" for i in range(30))
    got = {r.doc_id: r.text for r in substring_dedup(documents(spark, [(1, f"a {line} b"), (2, f"c {line}\n d")])).collect()}
    assert got == {1: f"a {line} b", 2: "c d"}


def test_vectors():
    column = pa.array(["a bb  c", "", " bb", "c", "é\n"])
    data, offsets = text_bytes(column)
    start, end, doc = words(data, offsets)
    assert [bytes(data[s:e]).decode() for s, e in zip(start, end)] == ["a", "bb", "c", "bb", "c", "é"] and doc.tolist() == [0, 0, 0, 2, 3, 4]
    h = word_hashes(data, start, end, 1)
    assert h[1] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 4
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64)
    assert sliding_argmin(values, 3).tolist() == [i + int(np.argmin(values[i : i + 3])) for i in range(5)]
    assert len(rolling(values, 8)) == 0
    bits = Bits(12)
    bits.bits[0] = 2
    assert bits.has(np.array([1, 2, 4097], np.uint64)).tolist() == [True, False, True]

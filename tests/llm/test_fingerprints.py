import hashlib
import re

from pyspark.sql import functions as F
from tests.llm.cases import awkward, documents

from tarnlake.llm.fingerprints import FRACTION, LIMIT, containment, fingerprint, fingerprint_pairs, in_ranges, likeness, merged, op5_fingerprints


def order_of(rows):
    """Descending ids, null last."""
    return sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark, sf_small):
    for docs in (awkward(documents(spark).filter("doc_id is null or doc_id <> 15")), spark.read.parquet(f"{sf_small}/documents.parquet")):
        rows = order_of(docs.collect())
        want = {}
        for i, r in enumerate(rows):
            text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            want[r.doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, after), len(shingles(text)), len(shingles(edited)), len(shingles(after)))
        got = {r.doc_id: r for r in fingerprint_pairs(docs).collect()}
        assert got.keys() == want.keys()
        errors = []
        for k, (n, digest, edited, after, *sizes) in want.items():
            r = got[k]
            assert r.n_chars == n and hashlib.sha256(r.edited.encode()).hexdigest() == digest
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            for size, found, true in ((max(sizes[:2]), r.near_edited, edited), (max(sizes[::2]), r.near_next, after)):
                # a share of at least FRACTION * size hashes: six standard errors
                assert abs(found - true) <= 6 * (true * (1 - true) / max(1, FRACTION * size)) ** 0.5 + 1e-9 or size < 40
                errors.append(abs(found - true))
        assert sum(errors) / len(errors) < 0.05


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fingerprint_pairs(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0 and by[1].near_next == 0.0
    assert fingerprint_pairs(documents(spark, [])).count() == 0
    assert fingerprint_pairs(documents(spark, [(7, "one two")])).first().near_next == 1.0
    assert fingerprint_pairs(documents(spark, [(7, "a b"), (7, "a b"), (7, "c")])).count() == 3


def test_neighbours_over_many_buckets(spark):
    docs = documents(spark, [(i * 7 - 3000, f"t{i}") for i in range(9000)])
    got = {r.doc_id: r.edited for r in fingerprint_pairs(docs).collect()}
    for i in range(9000):
        text, after = f"t{i}", f"t{i - 1}" if i else "t8999"
        half = len(text) // 2
        assert got[i * 7 - 3000] == text[: len(text) - half] + after[:half]


def test_any_number_of_rows_may_share_an_id(spark):
    ids = [None] * 4000 + [5] * 3000 + list(range(6, 3000))
    rows = [(doc_id, f"{i:05d}" * 3) for i, doc_id in enumerate(ids)]
    after = {int(r.edited[:5]): int(r.edited[8:13]) for r in fingerprint_pairs(documents(spark, rows)).collect()}
    at, seen = len(ids) - 1, []
    for _ in ids:  # one cycle through all rows, by descending ids, null last
        seen.append(ids[at])
        at = after[at]
    assert at == len(ids) - 1 and seen == sorted(ids, key=lambda i: (i is None, -(i or 0))) and len(after) == len(ids)


def test_buckets(spark):
    cuts = list(range(0, 50_000, 3))
    df = spark.createDataFrame([(i,) for i in (-5, 0, 1, 2, 3, 383, 384, 385, 4997, 4998, 49_998, 60_000, None)], "doc_id bigint")
    for r in in_ranges(df, cuts).collect():
        assert r.bucket == (-1 if r.doc_id is None else sum(c <= r.doc_id for c in cuts))
    assert {r.bucket for r in in_ranges(df, []).collect()} == {-1, 0}


def test_one_fraction_for_all_texts(spark):
    """Whatever a text's size, its fingerprint is its hashes below LIMIT, or its smallest if there are none."""
    rows = [(n, " ".join(f"a{n}b{i}" for i in range(n + 4))) for n in (1, 2, 3, 5, 8, 20, 100, 129, 1000)]
    shared = {r.doc_id: r.fingerprint for r in fingerprint(documents(spark, rows)).collect()}
    for n, f in shared.items():
        assert 1 <= len(f) <= n and (all(h < LIMIT for h in f) or len(f) == 1)
    assert abs(len(shared[1000]) / 1000 - FRACTION) < 0.06
    below, above, empty = F.array(F.lit(LIMIT - 1)), F.array(F.lit(LIMIT + 1)), F.array().cast("array<bigint>")
    row = spark.range(1).select(
        likeness(above, above).alias("a"), likeness(above, F.array(F.lit(LIMIT + 2))).alias("b"), likeness(empty, empty).alias("c"), likeness(below, above).alias("d"),
        containment(above, below).alias("e"), containment(empty, below).alias("f"), merged(F.array(above, below)).alias("g"), merged(F.array(empty, empty)).alias("h"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h) == (1.0, 0.0, 1.0, 0.0, None, 0.0, [LIMIT - 1], [])


def test_registered_query(spark, sf_small):
    q = op5_fingerprints(spark, sf_small)
    rows = q.collect()
    assert len(rows) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    for r in rows:
        for c in (r.near_edited, r.near_next, r.kept_by_edited, r.inside_both):
            assert c is None or 0 <= c <= 1


def test_sketches_of_unequal_texts(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    part = " ".join(f"w{i}" for i in range(5000, 9000))
    f = fingerprint(documents(spark, [(1, long), (2, part)]))
    assert all(h < LIMIT for r in f.collect() for h in r.fingerprint)
    a, b = (f.filter(f"doc_id = {i}").select(F.col("fingerprint").alias(f"f{i}")) for i in (1, 2))
    row = a.join(b).select(containment(F.col("f2"), F.col("f1")).alias("inside"), containment(F.col("f1"), F.col("f2")).alias("share"), (merged(F.array("f1", "f2")) == F.col("f1")).alias("same")).first()
    assert row.inside == 1.0 and abs(row.share - 0.2) < 0.05 and row.same

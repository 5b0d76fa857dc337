import hashlib
import re
from collections import defaultdict

from tests.llm.cases import awkward, documents

from tarnlake.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", r.text or "")].append(r)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
        out += [(str(r.doc_id), str(keep), len(members), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    return sorted(out)


def test_against_brute_force(spark, sf_small):
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        want = brute(docs.collect())
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, hash_all=True).collect())
        assert got == want
        lazy = exact_dedup(docs).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in lazy) == [w[:4] for w in want]
        assert all(r.text_sha256 is not None for r in lazy if r.group_size > 1)


def test_beyond_the_broadcast_limit(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = sorted(map(str, exact_dedup(docs).collect()))
    monkeypatch.setattr("tarnlake.llm.exact_dedup.BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_dedup(docs).collect())) == want


def test_hot_group_and_empty(spark):
    docs = documents(spark, [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    rows = exact_dedup(docs, hash_all=True).collect()
    assert len(rows) == 3000 and sum(r.kept for r in rows) == 2001
    assert {r.keep_id for r in rows if r.doc_id % 3 == 0} == {0}
    assert exact_dedup(documents(spark, [])).count() == 0

import zlib

import numpy as np
import pytest
from tests.llm.cases import awkward, documents

from tarnlake.llm import quality as q


def whole(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def on(text):
    """All features of a text, one by one."""
    out = np.zeros(q.FEATURES)
    out[0], base = 1, 1
    for edges, x in zip(q.MEASURES.values(), q.measures(text), strict=True):
        out[base + sum(x > e for e in edges)] = 1
        base += len(edges) + 1
    return out


def test_moments_and_scores_equal_sums_over_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").union(documents(spark))
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    rows = q.coded(docs)
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    texts: dict = {}
    for i, t in whole(docs):
        texts[t] = texts.get(t, False) or i in good
    x = np.array([on(t) for t in texts])
    mine = np.array([*texts.values()])
    seen = {}
    original = q.moments
    try:
        q.moments = lambda t: seen.setdefault("m", original(t))
        model = q.fit(rows, labels)
    finally:
        q.moments = original
    assert (seen["m"][0] == x.T @ x).all() and (seen["m"][1] == x[mine].T @ x[mine]).all() and 0 < seen["m"][2][0, 0] < mine.sum()
    assert np.allclose(model.weights, q.minimised(x.T @ x, x[mine].T @ x[mine], model.prior, max(1e-3, 3 / mine.sum())))
    got = {}
    for r in q.score_documents(rows, model).collect():
        got.setdefault(r.doc_id, []).append((round(r.score, 9), r.held_out, r.predicted))
    want: dict = {}
    for i, t in whole(docs):
        score = min(1.0, max(0.0, (1 + on(t) @ model.weights) / 2))
        want.setdefault(i, []).append((round(score, 9), i is not None and zlib.crc32(str(i).encode()) % 4 == 2, int(score >= 0.7)))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_the_risk_is_least_and_not_negative():
    """No step from the weights lowers the risk, where the part for bad texts is positive and where it would be negative."""
    rng = np.random.default_rng(2)
    for size, prior in ((4000, 0.5), (30, 0.95)):
        x = np.column_stack([np.ones(size), rng.normal(size=(size, 6))])
        p = np.column_stack([np.ones(size // 2), rng.normal(0.7, 1, size=(size // 2, 6))])
        a, g = x.T @ x, p.T @ p
        w = q.minimised(a, g, prior, ridge=1e-6)
        mean = lambda rows, w, sign: np.mean((1 - sign * (rows @ w)) ** 2) / 4
        risk = lambda w: prior * mean(p, w, 1) + max(0.0, mean(x, w, -1) - prior * mean(p, w, -1))
        assert risk(w) >= 0 and all(risk(w + rng.normal(0, 0.02, 7)) > risk(w) - 2e-3 for _ in range(200))
    free = np.linalg.solve(a / a[0, 0] / 2, prior * g[0] / g[0, 0] - a[0] / a[0, 0] / 2)
    assert mean(x, free, -1) < prior * mean(p, free, -1) and risk(w) < risk(free)  # the plain minimum overfits


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_prior_is_estimated(share):
    rng = np.random.default_rng(3)
    good, bad = rng.normal(-1.5, 1, 20_000), rng.normal(1.5, 1, 100_000)
    n = int(100_000 * share)
    both = np.concatenate([rng.normal(-1.5, 1, n), bad[: 100_000 - n]])
    bins = np.linspace(-6, 6, 500)
    assert abs(q.estimated_prior(np.histogram(both, bins)[0], np.histogram(good, bins)[0]) - share) < 0.05


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in q.op12_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.1, (np.mean(good), np.mean(bad))


def test_awkward_rows(spark):
    docs = awkward(documents(spark))
    labels = spark.createDataFrame([(4, 1), (8, 1), (8, 0), (12, None), (None, 1), (15, 1), (999, 1)], "doc_id long, quality int").selectExpr("*", "1 as text", "'x' as key", "2 as codes")
    got = q.quality(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in whole(docs))
    assert all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    assert {r.score for r in q.quality(docs, labels.limit(0)).collect()} == {1.0}  # nothing is known, nothing is turned away
    assert q.quality(documents(spark, []), labels).collect() == []


def test_copies_have_no_weight(spark, sf_small):
    """A text copied ten thousand times moves the model as much as one copy of it."""
    docs, labels = spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet")
    extra = documents(spark, [(10_000 + i, "Shout!! Shout!! Shout!! | | |") for i in range(3)])
    one = q.fit(q.coded(docs.union(extra.limit(1))), labels)
    many = q.fit(q.coded(docs.union(extra.limit(1).crossJoin(spark.range(10_000)).drop("id"))), labels)
    assert one.prior == many.prior and (one.weights == many.weights).all()

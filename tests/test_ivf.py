import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument
from tarnlake.operators import ivf
from tarnlake.plans.retrieval import asked
from tarnlake.session import table

SCHEMA = "id long, embedding array<float>, kind string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_and_work(spark, sf):
    """Nine tenths of the true five best, with and without the query itself, with at most a tenth of the pairs scored and
    at most two thirds looked up by code; the sample holds no more rows than it may."""
    e = table(spark, f"/root/testdata/{sf}", "embeddings")
    cells = ivf.fit(e, "vec_id")
    indexed, queries = ivf.index(e, cells, "vec_id").cache(), asked(e)
    pairs = indexed.count() * queries.count()
    best = {}
    for r in ivf.exact_search(e, queries, id_col="vec_id").collect():
        best.setdefault(r["query"], set()).add(r.vec_id)
    got = {q: set() for q in best}
    for r in ivf.approximate_search(e, indexed, cells, queries, id_col="vec_id").collect():
        got[r["query"]].add(r.vec_id)
    assert len(best) == queries.count()
    assert np.mean([v in got[q] for q, own in best.items() for v in own]) >= 0.9
    assert np.mean([v in got[q] for q, own in best.items() for v in own if v != q]) >= 0.9
    looks = ivf.probes(queries, cells, int(np.ceil(0.6 * len(cells.centers))))
    assert ivf.candidates(indexed, looks, cells, 50, "vec_id").count() <= 0.1 * pairs + 1e-9
    assert looks.join(indexed, "cell").count() <= 0.67 * pairs


def test_exact_search_equals_numpy(spark, sf_small, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK_POINTS", 90)
    monkeypatch.setattr(ivf, "BLOCK_QUERIES", 7)
    rows = table(spark, sf_small, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = table(spark, sf_small, "embeddings")
    found = {}
    for r in ivf.exact_search(e, asked(e), id_col="vec_id").orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r.vec_id)
    for i in np.flatnonzero(ids % 20 == 0):
        assert found[int(ids[i])] == [int(ids[j]) for j in np.lexsort((ids, -np.round(x @ x[i], 12)))[:5]]


def test_a_hot_cell_is_cut_and_nothing_is_lost(spark, monkeypatch):
    """Half of all points are one vector: with small blocks their cell takes many steps, and the result is as before."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 2 else rng.normal(size=4).tolist(), "a" if i % 3 else "b") for i in range(600)]
    points = spark.createDataFrame(rows, SCHEMA)
    queries = points.filter("id < 30").select(F.col("id").alias("query"), "embedding")
    cells = ivf.fit(points)
    run = lambda **o: sorted(map(tuple, ivf.approximate_search(points, ivf.index(points, cells), cells, queries, collection="kind", share=1.0, **o).select("query", "kind", "rank", "id").collect()))
    whole = run(rerank=600)
    monkeypatch.setattr(ivf, "BLOCK_POINTS", 25)
    monkeypatch.setattr(ivf, "BLOCK_QUERIES", 4)
    assert run(rerank=600) == whole and len(whole) == 30 * 2 * 5


def test_awkward_vectors(spark):
    """Null, empty, zero, broken and longer vectors, and null ids, neither stop the search nor are found by vectors they lack."""
    rows = [(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], None), (4, [], "b"), (5, [1.0, 2.0, 3.0], "b"), (None, [1.0, 0.1], None), (7, [float("nan"), 1.0], "a"), (8, [0.0, 1.0], None), (8, [0.0, 1.0], None)]
    points = spark.createDataFrame(rows, SCHEMA)
    cells = ivf.fit(points)
    indexed = ivf.index(points, cells)
    assert {r.id for r in indexed.filter("cell is not null").collect()} == {1, None, 8} and indexed.count() == len(rows)
    queries = spark.createDataFrame([(1, [1.0, 0.05]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 2.0, 3.0])], "query long, embedding array<float>")
    got = ivf.approximate_search(points, indexed, cells, queries, share=1.0).collect()
    assert {r["query"] for r in got} == {1} and sorted(r.id for r in got) == [1, 8, 8]
    assert ivf.approximate_search(points, indexed, cells, queries.limit(0)).collect() == []
    assert ivf.exact_search(points.limit(0), queries).collect() == []
    with pytest.raises(InvalidArgument):
        ivf.fit(points.limit(0))
    with pytest.raises(InvalidArgument):
        ivf.approximate_search(points, indexed, cells, queries, top_k=0)


def test_the_sample_is_bounded(spark):
    points = spark.range(3000).selectExpr("id", "array(cast(sin(id) as float), cast(cos(id * 7) as float)) as embedding")
    cells = ivf.fit(points, sample_rows=160)
    assert len(cells.centers) == 10 and ivf.index(points, cells).filter("cell is null").count() == 0


def test_all_cells_and_candidates_without_a_row_a_pair(spark, sf_small, monkeypatch):
    """Over small blocks the exact way by code gives the SQL's rows, equal vectors by their ids, and hands on queries times blocks rows, not pairs."""
    monkeypatch.setattr(ivf, "BLOCK_POINTS", 400)
    monkeypatch.setattr(ivf, "BLOCK_QUERIES", 8)
    e = table(spark, sf_small, "embeddings")
    e = e.union(e.withColumn("vec_id", F.col("vec_id") + 100_000))
    queries, cells = asked(e), ivf.fit(e, "vec_id")
    found = ivf.approximate_search(e, ivf.index(e, cells, "vec_id"), cells, queries, top_k=3, threshold=0.2, share=1.0, rerank=1 << 30, id_col="vec_id", collection="label")
    own = e.alias("p").crossJoin(queries.alias("q")).select("query", "label", "vec_id", ivf.cosine(F.col("p.embedding"), F.col("q.embedding")).alias("score")).filter("score >= 0.2")
    want = ivf.last_n(own, ["query", "label"], [F.desc("score"), F.col("vec_id")], 3, "rank")
    key = lambda df: sorted((r["query"], r.label, r["rank"], r.vec_id, r.score) for r in df.collect())
    got = key(found)
    assert got == key(want) and len(got) > queries.count()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 1  # points with their codes; no join of pairs

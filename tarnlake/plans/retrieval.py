"""Queries over vectors and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import ivf, search
from tarnlake.operators.chunking import semantic_breaks
from tarnlake.operators.mutations import delete_points, set_payload
from tarnlake.operators.relational import adjacent_similarity
from tarnlake.session import table

COSINE = "list_inner_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.v, q.v)))"


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query is a parameter, as from an embedder; here a stored vector, one row by point lookup."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: the document with the vector's number, active unless labelled toxic."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "toxic")
    rows = e.join(d, e.vec_id == d.doc_id).join(labels, F.col("doc_id") == F.col("l_id"), "left")
    active = F.coalesce(F.col("toxic") == 0, F.lit(True))
    payload = F.struct(F.col("text").alias("content"), F.struct(F.col("vec_id").alias("document_chunk_id"), F.col("doc_id").alias("document_id"), F.col("label").alias("knowledge_id"), active.alias("is_active")).alias("metadata"), F.lit(True).alias("document_is_active"))
    return rows.select(F.col("vec_id").alias("id"), F.col("label").alias("knowledge_id"), "embedding", payload.alias("payload"))


def _hits(spark, sf_dir, **options) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.search(e, query_vector(spark, sf_dir), collection="label", id_col="vec_id", **options)


def vector_topk_per_collection(spark, sf_dir):
    return _hits(spark, sf_dir, top_k=5, threshold=0.0).select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_search_flat(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = search.retrieve(e, query_vector(spark, sf_dir), 3, 0.1, collection="label", id_col="vec_id", collections=[0, 2, 4, 6, 8])
    return hits.select("label", "vec_id", F.round("score", 6).alias("score"))


def retrieved_context(spark, sf_dir):
    p = points(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "source", "n_chars")
    settings = {"list_knowledge_ids": list(range(10)), "top_k": 4, "search_accuracy": 0.0}
    hits = search.retrieved_context(p, documents, settings, query_vector(spark, sf_dir))
    return hits.select("id", "knowledge_id", F.round("score", 6).alias("score"), "source", "n_chars", F.md5("payload.content").alias("content_md5"))


def rrf_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = search.search_many(e, [query_vector(spark, sf_dir, v) for v in (0, 1, 2)], 2, 0.0, collection="label", id_col="vec_id")
    return search.fuse(search.ranked_lists(hits, "vec_id"), "vec_id").select("vec_id", "best_rank", F.round("fused", 8).alias("fused"))


def relevance_filter(spark, sf_dir):
    e = search.relevant(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), threshold=0.2)
    return e.select("vec_id", F.round("similarity", 6).alias("similarity"))


def multi_query_search(spark, sf_dir):
    queries = [query_vector(spark, sf_dir, v) for v in (0, 1)]
    rows = search.multi_query(points(spark, sf_dir), queries, threshold=0.0, relevance=0.05)
    return rows.select("id", F.round("fused", 8).alias("fused"), F.md5("content").alias("content_md5"))


def asked(e: DataFrame) -> DataFrame:
    """Every twentieth vector as a query."""
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


def approximate_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cells = ivf.fit(e, "vec_id")
    found = ivf.approximate_search(e, ivf.index(e, cells, "vec_id"), cells, asked(e), id_col="vec_id")
    return found.select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


def nearest_vectors(spark, sf_dir):
    """The exact way over the same queries."""
    e = table(spark, sf_dir, "embeddings")
    return ivf.exact_search(e, asked(e), id_col="vec_id").select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


def nearest_by_code(spark, sf_dir):
    """Through the inverted file with all cells and all candidates, of each collection: exact, by the whole of its path."""
    e = table(spark, sf_dir, "embeddings")
    cells = ivf.fit(e, "vec_id")
    found = ivf.approximate_search(e, ivf.index(e, cells, "vec_id"), cells, asked(e), top_k=2, threshold=0.2, share=1.0, rerank=1 << 30, id_col="vec_id", collection="label")
    return found.select("query", "label", "rank", "vec_id", F.round("score", 6).alias("score"))


def adjacent_breaks(spark, sf_dir):
    e = adjacent_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return semantic_breaks(e, 0.1).select("label", "vec_id", F.round("similarity", 6).alias("similarity"))


def payload_update(spark, sf_dir):
    p = set_payload(points(spark, sf_dir), {"metadata.is_active": False}, payload__metadata__knowledge_id=3)
    p = delete_points(p, payload__metadata__knowledge_id=5)
    return p.groupBy("knowledge_id").agg(F.count("*").alias("points"), F.count_if("payload.metadata.is_active").alias("active"))


POINTS = "p AS (SELECT e.vec_id AS id, e.label AS knowledge_id, e.embedding, d.text, d.source, d.n_chars, coalesce(l.toxic = 0, true) AS active FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"
QUERY = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {})"
RANKED = "s AS (SELECT e.label, e.vec_id, {c} AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= {t})"

ENTRIES = {
    "vector_topk_per_collection": (vector_topk_per_collection, f"WITH {QUERY.format(0)}, {RANKED.format(c=COSINE, t=0.0)} SELECT label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5"),
    "vector_search_flat": (vector_search_flat, f"WITH {QUERY.format(0)}, {RANKED.format(c=COSINE, t=0.1)} SELECT label, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3 AND label IN (0, 2, 4, 6, 8)"),
    "retrieved_context": (retrieved_context, f"WITH {POINTS}, {QUERY.format(0)}, s AS (SELECT e.*, {COSINE} AS score FROM p e, q WHERE active), r AS (SELECT *, row_number() OVER (PARTITION BY knowledge_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0) SELECT id, knowledge_id, round(score, 6) AS score, source, n_chars, md5(text) AS content_md5 FROM r WHERE rank <= 4"),
    "rrf_fusion": (rrf_fusion, f"WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 3), s AS (SELECT qid, e.label, e.vec_id, {COSINE} AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, vec_id) AS n FROM s WHERE score >= 0), f AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM r WHERE n <= 2) SELECT vec_id, min(rank) AS best_rank, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused FROM f GROUP BY vec_id"),
    "relevance_filter": (relevance_filter, f"WITH {QUERY.format(0)}, s AS (SELECT e.vec_id, {COSINE} AS similarity FROM embeddings e, q) SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.2"),
    "multi_query_search": (multi_query_search, f"WITH {POINTS}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 2), s AS (SELECT qid, e.knowledge_id, e.id, e.text, {COSINE} AS score FROM p e, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid, knowledge_id ORDER BY score DESC, id) AS n FROM s WHERE score >= 0), f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r WHERE n <= 2), u AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM f GROUP BY id) SELECT u.id, round(fused, 8) AS fused, md5(replace(replace(replace(replace(s.text, '[HEADING]', '### '), '[SUBHEADING]', '#### '), '[/HEADING]', chr(10)), '[/SUBHEADING]', chr(10))) AS content_md5 FROM u JOIN s ON s.id = u.id AND s.qid = 0 WHERE s.score >= 0.05 ORDER BY u.fused DESC, u.id LIMIT 8"),
    "approximate_search": (approximate_search, None),
    "nearest_vectors": (nearest_vectors, f"WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, e.vec_id, {COSINE} AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5"),
    "nearest_by_code": (nearest_by_code, f"WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, e.label, e.vec_id, {COSINE} AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2) SELECT query, label, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 2"),
    "adjacent_breaks": (adjacent_breaks, "WITH a AS (SELECT label, vec_id, embedding::DOUBLE[] AS x, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings), s AS (SELECT label, vec_id, list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) AS similarity FROM a WHERE y IS NOT NULL) SELECT label, vec_id, round(similarity, 6) AS similarity FROM s WHERE similarity < 0.1"),
    "payload_update": (payload_update, f"WITH {POINTS} SELECT knowledge_id, count(*) AS points, count(*) FILTER (WHERE active AND knowledge_id <> 3) AS active FROM p WHERE knowledge_id <> 5 GROUP BY knowledge_id"),
}

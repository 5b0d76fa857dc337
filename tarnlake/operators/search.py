"""Vector search over collections, rank fusion, retrieval with metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument
from tarnlake.functions.text import contains_any, to_markdown_tags
from tarnlake.functions.vectors import cosine_to, cosines_to
from tarnlake.operators.predicates import check_settings, equals
from tarnlake.operators.relational import hits_with_documents, last_n


def search(points: DataFrame, query: list[float], top_k: int = 5, threshold: float = 0.7, collections: list | None = None, collection: str = "knowledge_id", vector: str = "embedding", id_col: str = "id", **filters) -> DataFrame:
    """The top_k points of each collection with cosine >= threshold, with score and rank, without their vectors.

    Filters (a__b for nested fields) and collections are pushed to the scan; each task keeps top_k rows a collection
    before the shuffle. A collection that doesn't exist gives no rows.
    """
    return search_many(points, [query], top_k, threshold, collections, collection, vector, id_col, **filters).drop("query")


def search_many(points: DataFrame, queries: list[list[float]], top_k: int = 5, threshold: float = 0.7, collections: list | None = None, collection: str = "knowledge_id", vector: str = "embedding", id_col: str = "id", **filters) -> DataFrame:
    """search() for several query vectors in one pass over the points; query is a vector's number, from 0."""
    rows = points.filter(equals(**filters)) if filters else points
    if collections is not None:
        rows = rows.filter(F.col(collection).isin(collections))
    scored = rows.withColumn("_scores", cosines_to(F.col(vector), queries)).drop(vector)
    each = scored.select(*scored.columns[:-1], F.posexplode("_scores").alias("query", "score")).filter(F.col("score") >= threshold)
    return last_n(each, ["query", collection], [F.desc("score"), F.col(id_col)], top_k, "rank")


def ranked_lists(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """id_col, query, score and rank of search_many's hits: of each query one list over all collections."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), id_col)  # top_k rows a collection at most
    return hits.select(id_col, "query", "score", F.row_number().over(order).alias("rank"))


def retrieve(points: DataFrame, query: list[float], top_k: int = 5, threshold: float = 0.6, id_col: str = "id", **options) -> DataFrame:
    """Hits of all collections, best first; up to top_k of each, without a cut over all."""
    if not query:
        raise InvalidArgument("EMPTY_VECTOR", "the query vector is empty")
    return search(points, query, top_k, threshold, id_col=id_col, **options).orderBy(F.desc("score"), id_col)


def retrieved_context(points: DataFrame, documents: DataFrame, settings: dict, query: list[float]) -> DataFrame:
    """Active hits in the collections and with the limits of the settings, joined to their documents."""
    ids, top_k, accuracy = settings["list_knowledge_ids"], settings["top_k"], settings["search_accuracy"]
    check_settings(ids, top_k, accuracy)
    hits = search(points, query, top_k, accuracy, ids, payload__document_is_active=True, payload__metadata__is_active=True)
    return hits_with_documents(hits, documents)


def fuse(ranked: DataFrame, id_col: str, k: int = 60, rank: str = "rank") -> DataFrame:
    """Reciprocal-rank fusion of several rankings in one frame: the sum of 1 / (k + rank) of each id, ranks from 1."""
    out = ranked.groupBy(id_col).agg(F.sum(1.0 / (k + F.col(rank))).alias("fused"), F.min(rank).alias("best_rank"))
    return out.orderBy(F.desc("fused"), "best_rank", id_col)


def relevant(df: DataFrame, query: list[float], vector: str = "embedding", threshold: float = 0.5) -> DataFrame:
    return df.withColumn("similarity", cosine_to(F.col(vector), query)).filter(F.col("similarity") >= threshold)


def multi_query(points: DataFrame, queries: list[list[float]], per_query: int = 2, final: int = 8, id_col: str = "id", threshold: float = 0.6, relevance: float = 0.5, **options) -> DataFrame:
    """Retrieval for each query, fusion, relevance to the first query, Markdown tags, the best `final`. Needs payload.content."""
    if not queries:
        raise InvalidArgument("NO_QUERIES", "no query is given")
    fused = fuse(ranked_lists(search_many(points, queries, per_query, threshold, id_col=id_col, **options), id_col), id_col).select(id_col, "fused")
    rows = relevant(points.join(fused, id_col), queries[0], threshold=relevance)
    return rows.withColumn("content", to_markdown_tags(F.col("payload.content"))).orderBy(F.desc("fused"), id_col).limit(final)


# Words that point back to what was said before.
PRONOUNS = ["nó", "vậy", "đó", "kia", "trên", "dưới", "trước", "sau", "ý", "cái"]


def should_rewrite(question: Column, history_size: Column) -> Column:
    return (history_size >= 2) & contains_any(question, PRONOUNS)


def rewritten(messages: DataFrame, session: str, position: str, rewrite: Callable[[Column], Column] | None = None) -> DataFrame:
    """question of each session: the model's rewriting of its history, else its last user message."""
    mine = F.when(F.lower("role") == "user", F.col("text"))
    last = messages.groupBy(session).agg(F.max_by(mine, F.when(mine.isNotNull(), F.col(position))).alias("question"))
    return last.withColumn("question", F.coalesce(rewrite(F.col("question")), "question")) if rewrite else last

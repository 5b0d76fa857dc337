"""Joins, set operations, aggregates and rankings of the services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.text import role_of

# ---- joins ----------------------------------------------------------------------------------------------------------


def hits_with_documents(hits: DataFrame, documents: DataFrame, document_id: str = "payload.metadata.document_id") -> DataFrame:
    """Each hit with its document, best first. Hits are few, documents many: Spark broadcasts hits where they are small."""
    return hits.withColumn("_doc", F.col(document_id)).join(documents, F.col("_doc") == documents["_id"]).drop("_doc").orderBy(F.desc("score"), "id")


def exists_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_semi")


def absent_from(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti")


def repeated_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")


def insertable(new: DataFrame, old: DataFrame, on: list[str]) -> DataFrame:
    """New rows whose key neither an old row nor another new row has."""
    once = new.join(repeated_keys(new, on).select(*on), on, "left_anti")
    return absent_from(once, old, on)


def sync_status(points: DataFrame, chunks: DataFrame, chunk_id: str = "payload.metadata.document_chunk_id") -> DataFrame:
    """Points with is_active of the chunk they were made from, if it is among the chunks given."""
    new = chunks.select(F.col("_id").alias("_chunk"), F.col("is_active").alias("_active"))
    joined = points.join(new, F.col(chunk_id) == F.col("_chunk"), "left")
    active = F.coalesce("_active", F.col("payload.metadata.is_active"))
    return joined.withColumn("payload", F.col("payload").withField("metadata.is_active", active)).drop("_chunk", "_active")


# ---- sets -----------------------------------------------------------------------------------------------------------


def union_points(a: Column, n: Column) -> Column:
    """Sorted set of split points with the last one added."""
    return F.array_sort(F.array_union(a, F.array(n)))


def pull(array: Column, value) -> Column:
    return F.array_remove(array, value)


def bag_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---- aggregates -----------------------------------------------------------------------------------------------------


def average_or_zero(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(f"avg_{value}"))


def collection_stats(documents: DataFrame) -> DataFrame:
    """document_count and total_size_bytes of each knowledge base, counted anew."""
    return documents.groupBy("knowledge_id").agg(F.count("*").alias("document_count"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("total_size_bytes"))


def content_hashes(df: DataFrame, content: str, hot_share: int = 512) -> DataFrame:
    """file_hash (MD5) of each row's content, and how many rows have it.

    Contents that at least 1 / hot_share of all rows have, which are hot_share at most, are broadcast with their counts;
    their rows take keys of their own in the join that all other rows meet their counts in, and so are spread over it.
    """
    hashed = df.withColumn("file_hash", F.md5(F.col(content)))
    counts = hashed.groupBy("file_hash").agg(F.count("*").alias("copies"))
    least = max(2, -(-df.count() // hot_share))
    hot = counts.filter(F.col("copies") >= least).select(F.col("file_hash").alias("_hot"), F.col("copies").alias("_hot_copies"))
    cold = counts.filter(F.col("copies") < least).select(F.col("file_hash").alias("_cold"), "copies")
    met = hashed.join(F.broadcast(hot), F.col("file_hash") == F.col("_hot"), "left").drop("_hot")
    key = F.when(F.col("_hot_copies").isNull(), F.col("file_hash")).otherwise(F.concat(F.lit("-"), F.xxhash64(*hashed.columns).cast("string")))
    met = met.withColumn("_key", key).join(cold, F.col("_key") == F.col("_cold"), "left")
    return met.select("file_hash", *[c for c in hashed.columns if c != "file_hash"], F.coalesce("_hot_copies", "copies").alias("copies"))


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(position).alias("first_position"))


def joined_text(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: values of a group as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


# ---- rankings -------------------------------------------------------------------------------------------------------


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group in the given order; Spark cuts groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return last_n(df, key, order, 1, "_rn").drop("_rn")


def session_history(messages: DataFrame, session: str, position: str, most: int = 20) -> DataFrame:
    """The oldest `most` messages of each session, oldest first, with role user or ai."""
    return last_n(messages, [session], [F.col(position).asc()], most).withColumn("role", role_of(F.col("role")))


def recent_history(messages: DataFrame, session: str, position: str, most: int = 10) -> DataFrame:
    """The newest `most` messages of each session; nth counts them from the oldest."""
    newest = last_n(messages, [session], [F.col(position).desc()], most, "_rn").drop("_rn")
    return newest.withColumn("nth", F.row_number().over(Window.partitionBy(session).orderBy(position)))


def adjacent_similarity(df: DataFrame, by: str, position: str, embedding: str, rows: int = 10_000) -> DataFrame:
    """similarity of each row to the one before it in its group, null for the first.

    Groups may be large and few, so their rows are dealt into stretches of about `rows` neighbouring positions, by
    approximate percentiles of the positions; a stretch's last row is copied to the stretch that follows it in its group.
    What is kept of stretches (a percentile, and of each group and stretch the last position) is short.
    """
    from tarnlake.functions.vectors import cosine

    parts = max(1, min(4096, df.count() // rows))
    cuts = sorted(set(df.select(F.percentile_approx(position, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [])) if parts > 1 else []
    stretch = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(position))) if cuts else F.lit(0)
    dealt = df.withColumn("_stretch", stretch)
    ends = dealt.groupBy(by, "_stretch").agg(F.max(position).alias("_last"))
    onward = ends.withColumn("_to", F.lead("_stretch").over(Window.partitionBy(by).orderBy("_stretch"))).filter("_to is not null")
    keys = onward.select(F.col(by).alias("_by"), F.col("_last"), "_to")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col(position) == F.col("_last"))
    extra = df.join(F.broadcast(keys) if parts < 4096 else keys, same).select(*df.columns, F.col("_to").alias("_stretch"), F.lit(True).alias("_extra"))
    every = dealt.withColumn("_extra", F.lit(False)).unionByName(extra)
    before = F.lag(embedding).over(Window.partitionBy(by, "_stretch").orderBy(F.desc("_extra"), position))
    return every.withColumn("_before", before).filter("not _extra").withColumn("similarity", cosine(F.col("_before"), F.col(embedding))).drop("_before", "_stretch", "_extra")


def carry_forward(df: DataFrame, value: str, by: str, position: str) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))

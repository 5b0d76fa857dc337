"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import SPACE, attach, documents, row_count, stored


#: Pairs of length and prefix hash that may be broadcast.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix_chars: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space. Of equal texts, the one with the most code points
    before that, then with the smallest id (null last) stays. Rows are grouped by length; where a length repeats, by
    the hash of a prefix; where that repeats too, by SHA-256 of the whole text. Only this last step needs whole texts:
    without hash_all, only rows that reach it are hashed, and text_sha256 is null for the rest.
    Groups are aggregated before they are shuffled and joined back by `attach`, so a group may hold any share of rows.

    Null texts count as empty; all empty texts are one group. A null id is an id like others. Rows that repeat an id
    with an equal text of the same length are the same row twice: both count in group_size and get the same flags.
    An empty table gives an empty result. Further columns of docs are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("norm", normalised(F.col("text")))
    keys = d.select(
        "doc_id",
        F.char_length("text").cast("long").alias("chars"),
        F.char_length("norm").cast("long").alias("len"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("pre"),
        *([F.sha2("norm", 256).alias("full")] if hash_all else []),
    )
    keys = stored(keys, "dedup-keys")
    total = row_count(keys)
    by_length = keys.groupBy("len").agg(F.count("*").alias("n_len")).filter("n_len > 1")
    same_length = attach(keys, by_length, ["len"], "n_len", total)
    by_prefix = same_length.filter("n_len > 1").groupBy("len", "pre").agg(F.count("*").alias("n_pre")).filter("n_pre > 1")
    if hash_all:
        rows = attach(same_length, by_prefix, ["len", "pre"], "n_pre", total)
    else:
        # Texts are read again, only to hash the rows whose length and prefix repeat. Those pairs are broadcast up to
        # BROADCAST_ROWS (16 bytes each); beyond, hashing all texts costs less than shuffling them to meet the pairs.
        found = stored(by_prefix, "dedup-prefix")
        again = d.select("doc_id", F.char_length("text").cast("long").alias("chars"), F.char_length("norm").cast("long").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("pre"), "norm")
        if row_count(found) <= BROADCAST_ROWS:
            hit = again.join(F.broadcast(found.withColumnsRenamed({"len": "_l", "pre": "_p"})), (F.col("len") == F.col("_l")) & (F.col("pre") == F.col("_p")), "left")
            rows = hit.withColumn("full", F.when(F.col("n_pre").isNotNull(), F.sha2("norm", 256))).drop("norm", "_l", "_p")
        else:
            rows = attach(again.withColumn("full", F.sha2("norm", 256)).drop("norm"), found, ["len", "pre"], "n_pre", total)
            rows = rows.withColumn("full", F.when(F.col("n_pre").isNotNull(), F.col("full")))
    rows = rows.drop("n_len")
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    groups = rows.filter("n_pre > 1").groupBy("len", "full").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    groups = groups.select("len", "full", "group_size", F.col("best.id").alias("keep_id"), F.lit(True).alias("many"))
    out = attach(rows, groups, ["len", "full"], "group_size", total)
    keep = F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), hash_all=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

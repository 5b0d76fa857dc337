"""Document fingerprints: every word-shingle hash below a fixed fraction of all hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import SPACE, documents, input_bytes, row_count

#: The fraction of all hashes that is kept, whatever the text: those below LIMIT.
FRACTION = 0.25
LIMIT = -(1 << 63) + int(FRACTION * (1 << 64))
#: Text in a range of neighbouring ids; the driver sees a few numbers of each range.
RANGE_BYTES = 64 << 20


def with_shingles(df: DataFrame, text: str, out: str, size: int = 5, words: Column | None = None) -> DataFrame:
    """df with `out`, the distinct hashes of each run of `size` words of the text; shorter texts have one hash of all words, empty ones none."""
    w, h = f"_{out}_w", f"_{out}_h"
    split = F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "") if words is None else words
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(size)]))
    return df.withColumn(h, F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))).withColumn(out, F.array_distinct(h)).drop(w, h)


def sketch(shingles: Column) -> Column:
    """The fingerprint of distinct shingle hashes, sorted: those below LIMIT; of a text without any there, the smallest,
    which says that it isn't empty and lets equal texts be told from others."""
    kept = F.filter(shingles, lambda x: x < LIMIT)
    return F.when((F.size(kept) > 0) | (F.size(shingles) == 0), F.array_sort(kept)).otherwise(F.array(F.array_min(shingles)))


def shown(fingerprint: Column) -> Column:
    """As text: sixteen hexadecimal digits a hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _below(a: Column) -> Column:
    return F.filter(a, lambda x: x < LIMIT)


def _ratio(a: Column, b: Column, below: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double") / below


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two texts (Jaccard), from their fingerprints: that of the hashes
    below LIMIT; if neither has any there, whether the smallest are equal, which has the same expectation. Two empty
    fingerprints are alike (1)."""
    x, y = _below(a), _below(b)
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ > 0, _ratio(x, y, all_)).otherwise((a == b).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too, from fingerprints, however unequal the texts; null if a has
    shingles, but none of their hashes is below LIMIT. An empty a has no share (0)."""
    x, y = _below(a), _below(b)
    return F.when(F.size(x) > 0, _ratio(x, y, F.size(x))).when(F.size(a) == 0, 0.0)


def merged(fingerprints: Column) -> Column:
    """The fingerprint of all texts in a group together, from an array of theirs."""
    all_ = F.array_distinct(F.flatten(fingerprints))
    return sketch(all_)


def fingerprint(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5) -> DataFrame:
    """doc_id and fingerprint (array of hashes) of each row; a pure projection. Null texts count as empty."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_shingles(d, "text", "shingles", size).select("doc_id", sketch(F.col("shingles")).alias("fingerprint"))


def in_ranges(df: DataFrame, cuts: list[int]) -> DataFrame:
    """df with `bucket`, how many cuts aren't above its doc_id (null: -1): first among every fan-th, then among those
    between, which a broadcast table has (8 bytes a cut)."""
    if not cuts:
        return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    fan = max(128, math.isqrt(len(cuts)))
    parts = [(i // fan, cuts[i : i + fan]) for i in range(0, len(cuts), fan)]
    table = df.sparkSession.createDataFrame(parts, "_part int, _cuts array<bigint>")
    part = F.size(F.filter(F.lit(cuts[::fan]), lambda c: c <= F.col("doc_id"))) - 1
    within = F.size(F.filter("_cuts", lambda c: c <= F.col("doc_id")))
    met = df.withColumn("_at", F.when(F.col("doc_id").isNotNull(), part)).join(F.broadcast(table), F.col("_at") == F.col("_part"), "left")
    bucket = F.when(F.col("doc_id").isNull(), -1).when(F.col("_at") < 0, 0).otherwise(F.col("_at") * fan + within)
    return met.withColumn("bucket", bucket).drop("_at", "_part", "_cuts")


def _placed(df: DataFrame, cuts: list[int], hot: DataFrame | None) -> DataFrame:
    """df with bucket and `sub`: an id with very many rows, which begins a range, has the range's first `subs` parts, by
    its rows' order (their hashes, uid); the range's other ids come after them."""
    df = in_ranges(df, cuts)
    last = F.lit(1 << 40)
    if hot is None:
        return df.withColumn("sub", last)
    met = df.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("_hot_id")), "left")
    sub = F.floor((F.col("uid") / F.lit(2.0**64) + 0.5) * F.col("_subs"))
    return met.withColumn("sub", F.coalesce(sub, last)).drop("_hot_id", "_subs")


def _with_next(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text) with fingerprint, next_text and next_fingerprint.

    A window over all ids would be one task. Ids are dealt into ranges by approximate percentiles, as many as there are
    RANGE_BYTES of text (more if that leaves cores idle); an id with the rows of two ranges or more is split by a hash
    of its texts, by which its rows are ordered. Texts are shuffled once, by range, and each range is sorted by itself.
    What a range's first row needs, the last row of the range below, is sent there as one row more. The driver gets a
    few numbers of each range.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("uid", F.xxhash64("doc_id", "text"))
    ids = docs.select("doc_id")
    rows = row_count(ids)
    count = max(1, min(rows // 1000, max(input_bytes(docs) // RANGE_BYTES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    cuts: list[int] = []
    hot = None
    if count > 1:
        per = -(-rows // count)
        cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 50 * count)).first()[0] or []))
        many = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * per).collect()  # count / 2 rows at most
        cuts = sorted({*cuts, *(r.doc_id for r in many if r.doc_id is not None)})
        if many:
            hot = spark.createDataFrame([(r.doc_id, -(-r.n // per)) for r in many], f"_hot_id {docs.schema['doc_id'].dataType.simpleString()}, _subs bigint")
    place = ["bucket", "sub"]
    found = _placed(docs, cuts, hot)
    tops = {(r.bucket, r.sub): r.top for r in found.groupBy(*place).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    above = [(tops[order[i - 1]], order[i - 1][1], *k) for i, k in enumerate(order)]
    ends = spark.createDataFrame(above, f"_top {docs.schema['doc_id'].dataType.simpleString()}, _sub bigint, _to int, _to_sub bigint")
    more = found.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("sub") == F.col("_sub")))
    more = more.select("doc_id", "text", "uid", F.col("_to").alias("bucket"), F.col("_to_sub").alias("sub"), F.lit(1).alias("extra"))
    every = found.withColumn("extra", F.lit(0)).unionByName(more).repartition(*place)
    every = with_shingles(every, "text", "shingles", size).withColumn("fingerprint", sketch(F.col("shingles"))).drop("shingles")
    w = Window.partitionBy(*place).orderBy(F.desc("extra"), F.col("doc_id").asc_nulls_first(), "uid")
    return every.withColumns({"next_text": F.lag("text").over(w), "next_fingerprint": F.lag("fingerprint").over(w)}).filter("extra = 0")


def fingerprint_pairs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next.

    edited is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, by descending doc_id (null last), after the last the first. Texts are shuffled once.

    Null texts count as empty, n_chars 0. Rows that repeat an id follow each other in the order of a hash of their
    texts; any number of rows may have one id, or none. A lone document is its own next. An empty table gives an empty
    result. Further columns are ignored, whatever their names. Ids are integers.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = _with_next(d, size).withColumn("n_chars", F.char_length("text").cast("long"))
    head, half = F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.expr("substring(next_text, 1, cast(n_chars div 2 as int))")
    out = out.withColumn("edited", F.concat(head, half))
    out = with_shingles(out, "edited", "edited_shingles", size).withColumn("edited_fingerprint", sketch(F.col("edited_shingles")))
    return out.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fingerprint_pairs; kept_by_edited is the estimated share of the text's shingles that the edited text has, inside_both
    that of the next text's within the merged fingerprint of this text and the edited one (both null where a sketch can't tell)."""
    p = fingerprint_pairs(documents(spark, sf_dir))
    own, edited, after = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return p.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(own).alias("fingerprint"), shown(edited).alias("edited_fingerprint"), "near_edited", "near_next",
        containment(own, edited).alias("kept_by_edited"), containment(after, merged(F.array(own, edited))).alias("inside_both"),
    )

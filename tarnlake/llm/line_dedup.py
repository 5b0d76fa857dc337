"""Removal of repeated lines by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import attach, documents, row_count, stored


def line_windows(d: DataFrame, size: int) -> DataFrame:
    """A row per window of `size` lines in a row: doc_id, uid, pos (from 0), and two hashes k1 and k2 of its lines."""
    lines = d.select("doc_id", "uid", F.split("text", "\n").alias("lines"))
    hashed = lines.select("doc_id", "uid", F.transform("lines", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"))).alias("h"))
    n = F.size("h")
    window = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("h", i + j)["a"] for j in range(size)]).alias("k1"), F.xxhash64(F.lit(3), *[F.get("h", i + j)["b"] for j in range(size)]).alias("k2"))
    windows = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), window))
    return hashed.select("doc_id", "uid", F.inline(windows))


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3) -> DataFrame:
    """docs with its text's repeated lines removed, and n_lines and n_removed, which replace columns of these names; n_chars, if there, follows.

    Lines are what "\\n" separates. A window of `size` lines in a row is repeated if equal lines also start earlier, in
    a document with a smaller id (null last) or earlier in the same one; windows are judged on the input, and every
    line that a repeated window covers goes. Windows are counted by 128-bit hashes before they are shuffled, and the
    earliest place is joined back by `attach`, so a window may be any share of all. Texts are shuffled once, to meet
    the lines they lose.

    Null texts have no lines and stay null; texts with fewer lines than a window stay whole; a text that loses all
    its lines becomes empty. Rows that repeat an id with an equal text have equal places, none of which is earlier,
    and lose the same lines. An empty table gives an empty result. Other columns stay, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    d = docs.select(row, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    windows = stored(line_windows(d, size), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("pos").alias("pos"))
    sources = windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("source")).filter("n > 1")
    repeats = attach(windows, sources, ["k1", "k2"], "n", row_count(windows)).filter(F.col("source").isNotNull() & (place > F.col("source")))
    gone = repeats.select(F.col("doc_id").alias("_id"), F.col("uid").alias("_uid"), "pos").distinct().groupBy("_id", "_uid").agg(F.collect_list("pos").alias("_at"))
    out = d.join(gone, (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_lines", F.split("text", "\n"))
    covered = F.flatten(F.transform("_at", lambda p: F.sequence(p, p + size - 1)))
    kept = F.when(F.col("_at").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered))
    out = out.withColumn("_kept", kept)
    text = F.when(F.col("_kept").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    n = F.when(F.col(f"_row.`{text_col}`").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    new = {text_col: text, "n_lines": n, "n_removed": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_kept").isNull(), F.col("_row.`n_chars`")).otherwise(F.char_length(text)).cast(kind)
    old = [c for c in docs.columns if c not in new]
    out = out.select(*[F.col(f"_row.`{c}`").alias(c) for c in old], *[v.alias(k) for k, v in new.items()])
    return out.select(*[f"`{c}`" for c in docs.columns], *[c for c in ("n_lines", "n_removed") if c not in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
w AS (SELECT doc_id, pos, line, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS nth FROM w WHERE b IS NOT NULL AND c IS NOT NULL),
g AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM f WHERE nth > 1),
k AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, pos)),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""

"""Event time: windows, joins of two streams, and rows that come too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """rows with `_at`, their time as a timestamp, and a watermark `delay` behind the newest."""
    return rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)


def _counts(rows: DataFrame, window: Column, by: list[str]) -> DataFrame:
    out = rows.groupBy(window.alias("_w"), *by).agg(F.count("*").alias("events"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "events")


def sliding_counts(rows: DataFrame, at: str, by: list[str], width: str, every: str, delay: str) -> DataFrame:
    """Events of each window of `width` that begins every `every`; a window is given once the watermark is past its end."""
    return _counts(timed(rows, at, delay), F.window("_at", width, every), by)


def session_counts(rows: DataFrame, at: str, by: list[str], gap: str, delay: str) -> DataFrame:
    """Events of each session: those of one key no further than `gap` from the one before; its end is the last one and the gap."""
    return _counts(timed(rows, at, delay), F.session_window("_at", gap), by)


def followed_by(first: DataFrame, then: DataFrame, key: str, at: str, id_col: str, within: str, delay: str) -> DataFrame:
    """key, id_col and at of each row of `first`, with the id and time (then_id, then_at) of each row of `then` of the same
    key up to `within` after it; nulls, once the watermark says that none can come any more, if there is none.

    Both sides have watermarks, so that each keeps only rows that may still meet one of the other."""
    a = timed(first.select(key, id_col, at), at, delay).withColumnRenamed("_at", "_a")
    b = timed(then.select(F.col(key).alias("_key"), F.col(id_col).alias("then_id"), F.col(at).alias("then_at")), "then_at", delay).withColumnRenamed("_at", "_b")
    near = (F.col(key) == F.col("_key")) & (F.col("_b") >= F.col("_a")) & (F.col("_b") <= F.col("_a") + F.expr(f"interval {within}"))
    return a.join(b, near, "left_outer").select(key, id_col, at, "then_id", "then_at")


def route_late(rows: DataFrame, at: str, delay: str, out: str, checkpoint: str, once: bool = True):
    """Starts a stream that parts rows by whether they come later than `delay` behind the newest row of the batches before:
    {out}/late/batch=n and {out}/on_time/batch=n. Windows over on_time, read as a stream with the same delay, lose nothing silently.

    Every batch also writes the newest time so far ({out}/clock/batch=n), one row. A batch that runs again after a failure reads
    the clocks of earlier batches alone, so that it parts its rows alike, and replaces what it wrote."""

    def work(batch: DataFrame, number: int) -> None:
        spark, time = batch.sparkSession, F.col(at).cast("timestamp")
        newest = _clock(spark, f"{out}/clock", number)
        limit = F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")
        kept = batch.persist()
        try:
            late = F.coalesce(time < limit, F.lit(False))
            kept.filter(late).write.mode("overwrite").parquet(f"{out}/late/batch={number}")
            kept.filter(~late).write.mode("overwrite").parquet(f"{out}/on_time/batch={number}")
            clock = kept.agg(F.greatest(F.max(time), F.lit(newest).cast("timestamp")).alias("newest"))
            clock.write.mode("overwrite").parquet(f"{out}/clock/batch={number}")
        finally:
            kept.unpersist()

    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def _clock(spark: SparkSession, path: str, before: int):
    if before == 0:
        return None
    found = spark.read.option("basePath", path).schema("newest timestamp, batch long").parquet(path)
    return found.filter(F.col("batch") < before).agg(F.max("newest")).first()[0]


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table: {folder}/out, with its checkpoint in {folder}/checkpoint, so that
    a further call after more input gives what it adds as well."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")

"""Document jobs as a stream: files of JSON messages, idempotent sinks, an append-only status log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.operators.relational import latest_per_key

MESSAGE = "id string, type string, created_at timestamp"
#: Progress of each stage of an upload, on a scale of 0 to 100.
UPLOAD_STAGES = [("fetched", 10.0), ("hashed", 15.0), ("parsed", 30.0), ("chunked", 40.0), ("scored", 50.0), ("chunks_saved", 65.0), ("vectors_saved", 80.0), ("completed", 100.0)]
TRAINING_STAGES = [("loaded", 15.0), ("prepared", 20.0), ("embedding", 30.0), ("embedded", 80.0), ("saved", 90.0), ("completed", 100.0)]
TYPES = ["upload_document", "training_document"]


def enqueue(jobs: DataFrame, path: str) -> None:
    """Messages {id, type, created_at} added to the queue folder."""
    jobs.select("id", "type", "created_at").write.mode("append").json(path)


def read_jobs(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(path)


def fresh_jobs(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each id once, as long as its repeats come within the delay; state older than that is dropped."""
    return jobs.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])


def normal_progress(progress):
    """Progress on one scale: values up to 1 are fractions."""
    return F.when((progress > 0) & (progress <= 1), progress * 100).otherwise(progress)


def status_rows(jobs: DataFrame, stages: list[tuple[str, float]] = UPLOAD_STAGES) -> DataFrame:
    """A log row per job and stage, in order."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("message"), F.lit(p).alias("progress")) for i, (n, p) in enumerate(stages)])
    rows = jobs.select("id", "type", F.inline(steps))
    status = F.when(F.col("progress") >= 100, "completed").otherwise("processing")
    return rows.withColumn("status", status)


def current_status(log: DataFrame) -> DataFrame:
    """The newest row of each job's log."""
    return latest_per_key(log, ["id"], [F.desc("step")])


def job_states(events: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """State of each job from a log of events: pending, processing, completed or failed, with its last progress."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dispatch(batch: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """Results of each type's handler, and the messages of types that have none."""
    out = None
    for kind, handler in handlers.items():
        part = handler(batch.filter(F.col("type") == kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, batch.filter(~F.coalesce(F.col("type").isin(list(handlers)), F.lit(False)))


def run_jobs(spark: SparkSession, queue: str, out: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], once: bool = True, every: str = "3 seconds", delay: str = "1 hour"):
    """Starts the stream. An id is worked on once, as long as its repeats come within `delay` of event time: fresh_jobs
    keeps the ids, and forgets those that are older. Results, dead letters and finished ids of batch n are written to
    folders named after n, so that a batch that runs again after a failure replaces what it wrote."""

    def work(batch: DataFrame, number: int) -> None:
        fresh = batch.persist()
        try:
            results, dead = dispatch(fresh, handlers)
            if results is not None:
                results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")
            dead.write.mode("overwrite").parquet(f"{out}/dead/batch={number}")
            fresh.select("id").write.mode("overwrite").parquet(f"{out}/done/batch={number}")
        finally:
            fresh.unpersist()

    writer = fresh_jobs(read_jobs(spark, queue), delay).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def dedupe_contents(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose content (MD5) is new, the first of each, and the duplicates of known files or of each other, which
    keep their path and hash but not their content. Only hashes and paths are shuffled to find them, aggregated first;
    contents stay where they are until the paths of new files (unique) pick theirs."""
    hashed = files.withColumn("file_hash", F.md5("content"))
    keys = hashed.select("path", "file_hash")
    first = keys.groupBy("file_hash").agg(F.min("path").alias("_first"))
    new = first.join(known.select("file_hash"), "file_hash", "left_anti")
    own = new.select(F.col("_first").alias("path"), F.col("file_hash").alias("_own"))
    fresh = hashed.join(own.select("path"), "path", "left_semi")
    again = keys.join(own, "path", "left").filter("_own is null").select("path", "file_hash")
    return fresh, again


def tumbling_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each kind per window, late ones up to the delay counted; an extra beyond the services' own operations."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    return rows.groupBy(F.window("_at", width), kind).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), kind, "events")

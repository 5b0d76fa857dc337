"""Queries that run as streams over tables, each to its end; what they have written is the result.

Windows and time-outs that the watermark hasn't passed when the table ends are still open, in the SQL too. Users, a week at a time,
stand for jobs, kinds of events for what happens to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import shared_folder, table
from tarnlake.sources.queue import JobQueue
from tarnlake.streaming import states
from tarnlake.streaming.history import HashHistory, deduplicate
from tarnlake.streaming.windows import followed_by, run_once, session_counts, sliding_counts

DELAY, DAY = "1 hour", 86400.0


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; the star lets a table be a file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def sliding_windows(spark, sf_dir):
    e = stream(spark, sf_dir, "events")
    return _ntz(run_once(sliding_counts(e, "ts", ["event_type"], "2 days", "1 day", DELAY), shared_folder(spark, "sliding")), "start", "end")


def session_windows(spark, sf_dir):
    e = stream(spark, sf_dir, "events")
    return _ntz(run_once(session_counts(e, "ts", ["user_id"], "12 hours", DELAY), shared_folder(spark, "sessions")), "start", "end")


def views_and_purchases(spark, sf_dir):
    e = stream(spark, sf_dir, "events")
    both = followed_by(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id", "ts", "event_id", "6 hours", DELAY)
    return run_once(both, shared_folder(spark, "joined")).withColumn("then_id", F.col("then_id").cast("string"))


def job_events(e: DataFrame) -> DataFrame:
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7)
    event = F.create_map(*[F.lit(x) for pair in {"signup": "pending", "view": "processing", "click": "processing", "purchase": "completed", "error": "failed"}.items() for x in pair])[F.col("event_type")]
    return e.select((F.col("user_id") * 10 + week).cast("long").alias("id"), "event_id", F.col("ts").cast("timestamp").alias("at"), event.alias("event"))


def job_state_machine(spark, sf_dir):
    log = run_once(states.job_log(job_events(stream(spark, sf_dir, "events")), DAY, DELAY), shared_folder(spark, "jobs"))
    return _ntz(states.final_states(log), "at").withColumnRenamed("at", "since")


def expiring_cache(spark, sf_dir):
    e = stream(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.col("ts").cast("timestamp").alias("at"))
    found = run_once(states.cached_lookups(e, lambda user: f"vector of {user}", DAY, DELAY), shared_folder(spark, "lookups"))
    return found.groupBy("id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.max("computed_at").cast("timestamp_ntz").alias("last_computed"), F.max("value").alias("value"))


def duplicate_contents(spark, sf_dir):
    history = HashHistory(shared_folder(spark, "history"))
    files = stream(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"))
    deduplicate(files, history, f"{history.folder}/checkpoint").awaitTermination()
    return history.results(spark)


def queued_jobs(spark, sf_dir):
    """Orders as jobs: written to a queue, read from it as a stream, each once, with what the other side sees of them."""
    spark.dataSource.register(JobQueue)
    folder = shared_folder(spark, "queue")
    kind = F.when(F.col("o_orderstatus") == "O", "upload_document").otherwise("training_document")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), kind.alias("type"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    jobs.write.format("job_queue").mode("append").save(f"{folder}/jobs")
    found = run_once(spark.readStream.format("job_queue").option("split", str(1 << 20)).load(f"{folder}/jobs"), folder)
    return found.groupBy("type", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("jobs"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.count_if(F.col("error").isNotNull()).alias("errors"))


WATERMARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events{})"
LEGAL = "coalesce(CASE WHEN pre IS NULL THEN ev = 'pending' WHEN pre = 'pending' THEN ev IN ('processing', 'failed') WHEN pre = 'processing' THEN ev IN ('processing', 'completed', 'failed') END, false)"

ENTRIES = {
    "sliding_windows": (sliding_windows, f"WITH w AS (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])::TIMESTAMP AS start FROM events) SELECT start, start + INTERVAL 2 DAY AS \"end\", event_type, count(*) AS events FROM w WHERE start + INTERVAL 2 DAY <= {WATERMARK.format('')} GROUP BY ALL"),
    "session_windows": (session_windows, f"WITH a AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER o + INTERVAL 12 HOUR, true)::INT AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", user_id, count(*) AS events FROM b GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= {WATERMARK.format('')}"),
    "views_and_purchases": (views_and_purchases, f"SELECT v.user_id, v.event_id, v.ts, p.event_id::VARCHAR AS then_id, p.ts AS then_at FROM events v LEFT JOIN events p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR WHERE v.event_type = 'view' AND (p.event_id IS NOT NULL OR v.ts + INTERVAL 6 HOUR < least({WATERMARK.format(chr(32) + 'WHERE event_type = ' + repr('view'))}, {WATERMARK.format(chr(32) + 'WHERE event_type = ' + repr('purchase'))}))"),
    "job_state_machine": (job_state_machine, f"""WITH RECURSIVE e AS (SELECT user_id * 10 + date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS id, ts, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS ev FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT DISTINCT id, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::TIMESTAMP AS t, 0::BIGINT AS accepted, 0::BIGINT AS rejected FROM o
 UNION ALL SELECT id, k, CASE WHEN legal THEN ev ELSE pre END, CASE WHEN legal THEN ts ELSE since END, accepted + legal::INT, rejected + (NOT legal)::INT FROM (SELECT *, {LEGAL} AS legal FROM
  (SELECT r.id, o.n AS k, o.ev, o.ts, r.accepted, r.rejected, CASE WHEN r.status = 'processing' AND o.ts > r.t + INTERVAL 1 DAY THEN 'failed' ELSE r.status END AS pre, CASE WHEN r.status = 'processing' AND o.ts > r.t + INTERVAL 1 DAY THEN r.t + INTERVAL 1 DAY ELSE r.t END AS since FROM r JOIN o ON o.id = r.id AND o.n = r.n + 1))),
z AS (SELECT *, status = 'processing' AND t + INTERVAL 1 DAY < {WATERMARK.format('')} AS over FROM r WHERE n = (SELECT max(n) FROM o WHERE o.id = r.id))
SELECT id, CASE WHEN over THEN 'failed' ELSE status END AS status, CASE WHEN over THEN t + INTERVAL 1 DAY ELSE t END AS since, accepted, rejected FROM z"""),
    "expiring_cache": (expiring_cache, """WITH RECURSIVE o AS (SELECT user_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT id, 0::BIGINT AS n, NULL::TIMESTAMP AS computed, 0::BIGINT AS hits, 0::BIGINT AS misses FROM o
 UNION ALL SELECT o.id, o.n, CASE WHEN o.ts <= r.computed + INTERVAL 1 DAY THEN r.computed ELSE o.ts END, r.hits + (CASE WHEN o.ts <= r.computed + INTERVAL 1 DAY THEN 1 ELSE 0 END), r.misses + (CASE WHEN o.ts <= r.computed + INTERVAL 1 DAY THEN 0 ELSE 1 END) FROM r JOIN o ON o.id = r.id AND o.n = r.n + 1)
SELECT id, hits, misses, computed AS last_computed, 'vector of ' || id AS value FROM r WHERE n = (SELECT max(n) FROM o WHERE o.id = r.id)"""),
    "queued_jobs": (queued_jobs, "SELECT CASE WHEN o_orderstatus = 'O' THEN 'upload_document' ELSE 'training_document' END AS type, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS jobs, count(DISTINCT o_orderkey) AS ids, min(o_orderkey::VARCHAR) AS first, 0::BIGINT AS errors FROM orders GROUP BY ALL"),
    "duplicate_contents": (duplicate_contents, "WITH d AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, md5(text) AS file_hash FROM documents), f AS (SELECT file_hash, min(path) AS first FROM d GROUP BY 1) SELECT path, file_hash, CASE WHEN path <> first THEN first END AS duplicate_of FROM d LEFT JOIN f USING (file_hash)"),
}

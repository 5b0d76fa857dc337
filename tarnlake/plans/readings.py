"""Queries over time series of people; events stand for health records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import health
from tarnlake.operators.mutations import upsert
from tarnlake.operators.predicates import since
from tarnlake.operators.relational import joined_text, last_n, latest_per_key
from tarnlake.session import table
from tarnlake.streaming.jobs import job_states, status_rows

HIGH, LOW = "purchase", "view"  # two kinds of events stand for the two parts of a pressure reading


def anchor_of(events):
    """The newest time there is, as a literal: results don't depend on the clock."""
    newest = events.agg(F.max("ts")).first()[0]
    return F.lit(None if newest is None else newest.isoformat(sep=" ")).cast("timestamp_ntz")


def _recent(spark, sf_dir, n, days=7):
    e = table(spark, sf_dir, "events")
    return health.recent_readings(e, anchor_of(e), n, kind="event_type", at="ts", id_col="event_id", days=days)


def recent_readings(spark, sf_dir):
    return _recent(spark, sf_dir, 3).select("user_id", "event_type", "event_id", "value", "rn")


def reading_trend_summary(spark, sf_dir):
    s = health.glucose_summary(_recent(spark, sf_dir, 5), "user_id", "event_type")
    return s.withColumn("mean_value", F.round("mean_value", 4))


def paired_reading_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.filter(F.col("event_type").isin(HIGH, LOW)).withColumn("kind", F.lit("pair"))
    recent = health.recent_readings(rows, anchor_of(e), 5, kind="kind", at="ts", id_col="event_id")
    s = health.pressure_summary(recent, "user_id", subtype="event_type", high=HIGH, low=LOW)
    return s.withColumns({c: F.round(c, 4) for c in ("mean_systolic", "mean_diastolic")})


def profile_context(spark, sf_dir):
    """Each customer who has events: profile and the ids of the newest three readings, as text."""
    recent = last_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    texts = recent.groupBy("user_id").agg(joined_text(F.col("event_id").cast("string"), F.col("rn"), ", ").alias("readings"))
    c = table(spark, sf_dir, "customer")
    rows = c.join(texts, F.col("c_custkey") == F.col("user_id"), "left")
    parts = F.concat_ws("\n", F.concat(F.lit("Bệnh nhân: "), "c_name"), F.concat(F.lit("loại "), "c_mktsegment"), F.concat(F.lit("Chỉ số: "), "readings"))
    return rows.select("c_custkey", parts.alias("context"))


def upsert_latest(spark, sf_dir):
    """The latest event of each person and kind, replaced by that of the last day where there is one."""
    e = table(spark, sf_dir, "events")
    old = latest_per_key(e.filter(~since("ts", anchor_of(e), 1)), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    new = latest_per_key(e.filter(since("ts", anchor_of(e), 1)), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return upsert(old, new, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


def job_stream_dedupe(spark, sf_dir):
    """Batch form of the job stream: each (user, kind) is a job id, its first event counts."""
    e = table(spark, sf_dir, "events")
    first = latest_per_key(e, ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])
    return first.select("user_id", "event_type", "event_id")


def status_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return job_states(e, "user_id", "at").select("user_id", F.col("event_type").alias("status"), "event_id")


def job_progress_log(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("upload_document").alias("type"))
    return status_rows(jobs).groupBy("status").agg(F.count("*").alias("n"), F.sum("progress").alias("progress"))


RECENT = "a AS (SELECT max(ts) AS m FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events, a WHERE ts >= m - INTERVAL 7 DAY)"
TREND = "CASE WHEN readings >= 2 AND latest > oldest THEN 'tăng' WHEN readings >= 2 AND latest < oldest THEN 'giảm' ELSE 'ổn định' END AS trend"

ENTRIES = {
    "recent_readings": (recent_readings, f"WITH {RECENT} SELECT user_id, event_type, event_id, value, rn FROM r WHERE rn <= 3"),
    "reading_trend_summary": (reading_trend_summary, f"WITH {RECENT}, g AS (SELECT user_id, event_type, count(*) AS readings, avg(value) AS mean_value, arg_min(value, rn) AS latest, arg_max(value, rn) AS oldest FROM r WHERE rn <= 5 GROUP BY ALL) SELECT user_id, event_type, readings, round(mean_value, 4) AS mean_value, latest, oldest, {TREND}, CASE WHEN mean_value > 8.0 THEN 'high' WHEN mean_value > 6.0 THEN 'medium' ELSE 'low' END AS band FROM g"),
    "paired_reading_summary": (paired_reading_summary, f"WITH a AS (SELECT max(ts) AS m FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events, a WHERE ts >= m - INTERVAL 7 DAY AND event_type IN ('{HIGH}', '{LOW}')), g AS (SELECT user_id, count(*) FILTER (WHERE event_type = '{HIGH}') AS readings, avg(value) FILTER (WHERE event_type = '{HIGH}') AS hi, coalesce(avg(value) FILTER (WHERE event_type = '{LOW}'), 0) AS lo, arg_min(value, rn) FILTER (WHERE event_type = '{HIGH}') AS latest, arg_max(value, rn) FILTER (WHERE event_type = '{HIGH}') AS oldest FROM r WHERE rn <= 5 GROUP BY user_id) SELECT user_id, readings, round(hi, 4) AS mean_systolic, round(lo, 4) AS mean_diastolic, latest, oldest, {TREND}, CASE WHEN hi > 140 OR lo > 90 THEN 'high' WHEN hi > 120 OR lo > 80 THEN 'borderline' ELSE 'stable' END AS band FROM g WHERE readings > 0"),
    "profile_context": (profile_context, "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), t AS (SELECT user_id, string_agg(event_id::VARCHAR, ', ' ORDER BY rn) AS readings FROM r WHERE rn <= 3 GROUP BY user_id) SELECT c_custkey, concat_ws(chr(10), 'Bệnh nhân: ' || c_name, 'loại ' || c_mktsegment, 'Chỉ số: ' || readings) AS context FROM customer LEFT JOIN t ON user_id = c_custkey"),
    "upsert_latest": (upsert_latest, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "job_stream_dedupe": (job_stream_dedupe, "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"),
    "status_latest": (status_latest, "SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "job_progress_log": (job_progress_log, "SELECT CASE WHEN p >= 100 THEN 'completed' ELSE 'processing' END AS status, count(*) AS n, sum(p) AS progress FROM orders, (SELECT unnest([10.0, 15.0, 30.0, 40.0, 50.0, 65.0, 80.0, 100.0]::DOUBLE[]) AS p) GROUP BY 1"),
}

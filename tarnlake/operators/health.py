"""Recent readings of each person: summaries, trends and bands."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import contains_any, format_number
from tarnlake.operators.predicates import since
from tarnlake.operators.relational import last_n

GLUCOSE, PRESSURE, SYSTOLIC, DIASTOLIC = "Đường huyết", "Huyết áp", "tâm thu", "tâm trương"
UP, DOWN, SAME = "tăng", "giảm", "ổn định"


def recent_readings(readings: DataFrame, anchor: datetime | Column, n: int = 3, kinds: list[str] | None = None, user: str = "user_id", kind: str = "type", at: str = "timestamp", id_col: str = "_id", days: int = 7) -> DataFrame:
    """The newest n readings of each person and kind in the last days before the anchor, with rn from 1."""
    rows = readings.filter(since(at, anchor, days))
    if kinds:
        rows = rows.filter(F.col(kind).isin(kinds))
    return last_n(rows, [user, kind], [F.desc(at), F.desc(id_col)], n)


def trend(newest: Column, oldest: Column, count: Column) -> Column:
    return F.when((count >= 2) & (newest > oldest), UP).when((count >= 2) & (newest < oldest), DOWN).otherwise(SAME)


def glucose_band(mean: Column) -> Column:
    return F.when(mean > 8.0, "high").when(mean > 6.0, "medium").otherwise("low")


def pressure_band(systolic: Column, diastolic: Column) -> Column:
    return F.when((systolic > 140) | (diastolic > 90), "high").when((systolic > 120) | (diastolic > 80), "borderline").otherwise("stable")


def summarise(recent: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """readings, mean_value, latest, oldest and trend of ranked readings (rn 1 is the newest)."""
    out = recent.groupBy(*by).agg(F.count("*").alias("readings"), F.avg(value).alias("mean_value"), F.min_by(value, "rn").alias("latest"), F.max_by(value, "rn").alias("oldest"))
    return out.withColumn("trend", trend(F.col("latest"), F.col("oldest"), F.col("readings")))


def glucose_summary(recent: DataFrame, *by: str) -> DataFrame:
    return summarise(recent, *by).withColumn("band", glucose_band(F.col("mean_value")))


def pressure_summary(recent: DataFrame, *by: str, subtype: str = "subtype", high: str = SYSTOLIC, low: str = DIASTOLIC) -> DataFrame:
    """Means of both subtypes among the readings already cut to the newest n, latest systolic, its trend, and the band.
    People without a systolic reading have no row; without a diastolic one its mean is 0."""
    kind = F.lower(F.col(subtype))
    top, bottom = F.when(kind == high.lower(), F.col("value")), F.when(kind == low.lower(), F.col("value"))
    rank = F.when(kind == high.lower(), F.col("rn"))
    out = recent.groupBy(*by).agg(F.count(top).alias("readings"), F.avg(top).alias("mean_systolic"), F.coalesce(F.avg(bottom), F.lit(0.0)).alias("mean_diastolic"), F.min_by(top, rank).alias("latest"), F.max_by(top, rank).alias("oldest"))
    out = out.filter("readings > 0").withColumn("trend", trend(F.col("latest"), F.col("oldest"), F.col("readings")))
    return out.withColumn("band", pressure_band(F.col("mean_systolic"), F.col("mean_diastolic")))


# Words that ask for a part of the profile.
ASKS = {"glucose": ["đường huyết", "glucose"], "pressure": ["huyết áp", "blood pressure"], "insulin": ["insulin", "tiêm"], "lifestyle": ["ăn", "chế độ", "lối sống"]}
TREND_WORDS = ["gần đây", "xu hướng", "thay đổi", "dạo này", "tuần trước"]


def profile_context(questions: DataFrame, profiles: DataFrame, readings: DataFrame, anchor: datetime) -> DataFrame:
    """questions (user_id, question) with context: what the profile and recent readings say about the words asked for.
    Empty without a profile, and for the user admin."""
    glucose = recent_readings(readings, anchor, 3, [GLUCOSE]).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("_g"))
    pressure = recent_readings(readings, anchor, 2, [PRESSURE]).filter(F.lower("subtype") == SYSTOLIC).groupBy("user_id").agg(F.avg("value").alias("_p"))
    q = questions.join(profiles, "user_id", "left").join(glucose, "user_id", "left").join(pressure, "user_id", "left")
    ask = {k: contains_any(F.col("question"), v) for k, v in ASKS.items()}
    values = F.array_join(F.transform("_g", lambda r: F.concat(F.format_string("%.1f", F.bround(r["value"], 1)), F.lit(" mmol/l"))), ", ")
    some = lambda ok, text: F.when(ok, text)
    parts = [
        F.format_string("Bệnh nhân: %s (ID: %s), %s tuổi, %s, tiểu đường loại %s", "full_name", "patient_id", "age", "gender", "diabetes_type"),
        some(ask["glucose"] & F.col("_g").isNotNull(), F.concat(F.lit("Đường huyết: "), values)),
        some(ask["glucose"] & (F.size("complications") > 0), F.concat(F.lit("Biến chứng: "), F.array_join("complications", ", "))),
        some(ask["pressure"] & F.col("_p").isNotNull(), F.concat(F.lit("Huyết áp: trung bình "), format_number(F.col("_p"), F.lit(0)), F.lit(" mmHg (Tâm thu)"))),
        some(ask["insulin"] & (F.col("insulin_schedule") != ""), F.concat(F.lit("Lịch tiêm insulin: "), F.col("insulin_schedule"))),
        some(ask["lifestyle"] & (F.col("lifestyle") != ""), F.concat(F.lit("Lối sống: "), F.col("lifestyle"))),
        some(ask["lifestyle"] & (F.col("bmi") != 0), F.concat(F.lit("BMI: "), format_number(F.col("bmi"), F.lit(1)))),
    ]
    known = F.col("full_name").isNotNull() & (F.col("user_id") != "admin")
    return q.select(*questions.columns, F.when(known, F.concat_ws("\n", *parts)).otherwise("").alias("context"))


def status_case(question: Column, has_profile: Column, has_glucose: Column, has_pressure: Column, has_systolic: Column) -> Column:
    """Which answer a status question gets."""
    return (
        F.when(~contains_any(question, TREND_WORDS), "general_knowledge")
        .when(~has_profile, "no_profile")
        .when(~has_glucose & ~has_pressure, "no_data")
        .when(contains_any(question, ["huyết áp"]), F.when(has_systolic, "pressure").otherwise("no_systolic"))
        .when(contains_any(question, ["đường huyết", "glucose"]), F.when(has_glucose, "glucose").otherwise("no_glucose"))
        .otherwise("both")
    )


def status_responses(questions: DataFrame, profiles: DataFrame, readings: DataFrame, anchor: datetime) -> DataFrame:
    """questions (user_id, question) with case and summary, the numbers an answer is written from."""
    g = glucose_summary(recent_readings(readings, anchor, 5, [GLUCOSE]), "user_id").select("user_id", F.struct("mean_value", "latest", "trend", "band").alias("g"))
    five = recent_readings(readings, anchor, 5, [PRESSURE])
    p = pressure_summary(five, "user_id").select("user_id", F.struct("mean_systolic", "mean_diastolic", "latest", "trend", "band").alias("p"))
    any_p = five.select("user_id").distinct().withColumn("any_p", F.lit(True))
    q = questions.join(profiles.select("user_id", F.lit(True).alias("known")), "user_id", "left")
    for part in (g, p, any_p):
        q = q.join(part, "user_id", "left")
    case = status_case(F.col("question"), F.col("known").isNotNull(), F.col("g").isNotNull(), F.col("any_p").isNotNull(), F.col("p").isNotNull())
    one, whole = F.lit(1), F.lit(0)
    glucose_text = F.concat(F.lit("Đường huyết trung bình: "), format_number("g.mean_value", one), F.lit(" mmol/l → "), F.col("g.band"), F.lit("\nĐo gần nhất: "), format_number("g.latest", one), F.lit(" mmol/l\nXu hướng: "), F.col("g.trend"))
    pressure_text = F.concat(F.lit("Huyết áp trung bình: "), format_number("p.mean_systolic", whole), F.lit("/"), format_number("p.mean_diastolic", whole), F.lit(" mmHg → "), F.col("p.band"), F.lit("\nXu hướng: "), F.col("p.trend"))
    text = F.when(F.col("case") == "pressure", pressure_text).when(F.col("case") == "glucose", glucose_text).when(F.col("case") == "both", F.concat_ws("\n", glucose_text, pressure_text))
    return q.withColumn("case", case).select(*questions.columns, "case", text.alias("summary"))

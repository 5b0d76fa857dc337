"""Answers to a table of messages: flags, class, route, prompt, generation, guard."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import guard_answer
from tarnlake.operators import dialogue, health

APOLOGY = "Xin lỗi, hiện tôi chưa thể trả lời. Vui lòng thử lại sau."


def answers(messages: DataFrame, history: DataFrame, contexts: DataFrame, profiles: DataFrame, readings: DataFrame, anchor: datetime | Column, generate: Callable[[Column], Column] | None = None, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """messages (user_id, session_id, question) with kind, route, case, prompt and answer.

    history has session_id, role, text and position; contexts has session_id and contexts (array of text, best first).
    label is a model that classifies where rules don't, generate one that writes; without it the prompt is the answer.
    """
    flags = dialogue.history_flags(history, "session_id", ai="ai")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", "role", "text").alias("line")))), lambda r: r["line"])
    turns = history.groupBy("session_id").agg(lines.alias("turns"))
    asked = messages.select("user_id", "question").distinct()
    context = health.profile_context(asked, profiles, readings, anchor)
    status = health.status_responses(asked, profiles, readings, anchor)
    m = messages.join(flags, "session_id", "left").join(turns, "session_id", "left").join(contexts, "session_id", "left")
    m = m.join(context, ["user_id", "question"], "left").join(status, ["user_id", "question"], "left")
    q = F.col("question")
    kind = dialogue.classify(q, label(q) if label else None)
    documents = F.coalesce(F.size("contexts") > 0, F.lit(False))
    m = m.withColumn("kind", kind).withColumn("route", dialogue.route(F.col("kind"), F.coalesce("context", F.lit("")) != "", documents, dialogue.is_greeting(q)))
    note = dialogue.history_note(F.coalesce("first_time", F.lit(True)), F.coalesce("has_previous_trend", F.lit(False)))
    none = F.array().cast("array<string>")
    prompt = (
        F.when(F.col("route") == "rag", dialogue.rag_prompt(q, F.coalesce("contexts", none), F.coalesce("turns", none)))
        .when(F.col("route") == "status", F.concat_ws("\n", note, F.coalesce("summary", F.col("case")), F.col("context")))
        .when(F.col("route") == "guidance", dialogue.canned_topic(q))
        .otherwise(F.col("route"))
    )
    m = m.withColumn("prompt", prompt)
    written = F.when(F.col("route").isin("rag", "status"), F.coalesce(generate(F.col("prompt")), F.lit(APOLOGY))).otherwise(F.col("prompt")) if generate else F.col("prompt")
    return m.select(*messages.columns, "kind", "route", "case", "prompt", guard_answer(written).alias("answer"))

"""Queries over conversations. The fixture's invented words get a vocabulary of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions.text import history_line, role_of
from tarnlake.operators import dialogue, relational, search
from tarnlake.session import table
from tarnlake.sources.tables import to_result_json

WORDS = {"greetings": ["hello", "etion"], "question_words": ["that"], "time_words": ["ing", "ung"], "personal": ["ou", "ich"], "health": ["the ", "der "], "diseases": ["er"], "comparisons": ["blest"], "invalid": ["xyz"]}


#: Words of the fixture's invented language in place of the older rules' own; texts may meet several.
OLDER_WORDS = [("invalid", ["ung", "ow"]), ("greeting", ["hello", "ing"]), ("trend_analysis", ["der "]), ("relational", ["the "]), ("personal_info", ["e"])]


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def question_route(spark, sf_dir):
    c = _turns(spark, sf_dir).filter("role = 'user'")
    kind = dialogue.classify(F.col("text"), words=WORDS)
    hello = dialogue.is_greeting(F.col("text"), WORDS["greetings"], WORDS["question_words"])
    return c.select("conv_id", "turn", kind.alias("kind"), dialogue.route(kind, F.col("turn") > 2, F.col("conv_id") % 2 == 0, hello).alias("route"))


def canned_answer(spark, sf_dir):
    c = _turns(spark, sf_dir).filter("role = 'user'")
    topic = dialogue.canned_topic(F.col("text"), [("thing", "one"), ("tion", "two"), ("und", "three")], ["est"])
    return c.select("conv_id", "turn", topic.alias("topic"))


def first_time_flags(spark, sf_dir):
    flags = dialogue.history_flags(_turns(spark, sf_dir), "conv_id", words=["thing", "nicht"])
    return flags.select("conv_id", "first_time", "has_previous_trend", dialogue.history_note(F.col("first_time"), F.col("has_previous_trend")).alias("note"))


def history_oldest20(spark, sf_dir):
    """With the service's limit, the operator's own."""
    return relational.session_history(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "role", "rn")


def history_last10(spark, sf_dir):
    """With the service's limit, the operator's own."""
    return relational.recent_history(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "nth")


def history_lines(spark, sf_dir):
    c = _turns(spark, sf_dir).withColumn("line", history_line(F.col("role"), F.col("text")))
    return c.groupBy("conv_id").agg(relational.joined_text(F.col("line"), F.col("turn"), "\n").alias("lines"))


def rag_prompts(spark, sf_dir):
    """The prompt of each session's last user message, with its turns as history; every second one has evidence."""
    c = _turns(spark, sf_dir)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    history = c.groupBy("conv_id").agg(turns.alias("history"))
    asked = search.rewritten(c, "conv_id", "turn").join(history, "conv_id")
    evidence = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("about "), "question"))
    prompt = dialogue.render_rag(F.lit("system"), F.coalesce("question", F.lit("")), evidence, F.col("history"))
    return asked.select("conv_id", F.md5(prompt).alias("prompt_md5"))


def trend_prompts(spark, sf_dir):
    """The prompt of each customer about their orders, greeted or not, with and without notes."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    notes = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("last "), F.col("last").cast("string")))
    prompt = dialogue.render_trend(F.lit("system"), F.concat(F.lit("how is "), "c_name"), F.col("c_name"), (F.col("c_custkey") % 90).cast("int"), F.col("c_mktsegment"), F.concat(F.col("n").cast("string"), F.lit(" orders")), notes, F.col("c_custkey") % 2 == 0, "### end")
    return c.select("c_custkey", F.md5(prompt).alias("prompt_md5"))


def last_user_message(spark, sf_dir):
    return search.rewritten(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", F.md5("question").alias("question_md5"))


def rewrite_gate(spark, sf_dir):
    counts = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("text", "turn").alias("text"))
    return counts.select("conv_id", search.should_rewrite(F.col("text"), F.col("n")).alias("rewrite"))


def role_normalised(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy(role_of(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


def session_messages(spark, sf_dir):
    """All sessions with their messages. The service's cap of 100 is one user's, and this table has no users."""
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


def result_json(spark, sf_dir):
    return to_result_json(_turns(spark, sf_dir).select("conv_id", "turn", "role"))


def older_labels(spark, sf_dir):
    c = _turns(spark, sf_dir).filter("role = 'user'")
    return c.select("conv_id", "turn", dialogue.older_label(F.col("text"), rules=OLDER_WORDS).alias("label"))


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_Q = {k: _any("q", v) for k, v in WORDS.items()}
KIND = f"CASE WHEN {_Q['greetings']} AND NOT {_Q['question_words']} THEN 'rag_only' WHEN {_Q['diseases']} AND {_Q['comparisons']} THEN 'rag_only' WHEN {_Q['time_words']} AND {_Q['health']} THEN 'trend' WHEN {_Q['personal']} AND {_Q['health']} THEN 'personal' WHEN {_Q['invalid']} THEN 'invalid' WHEN {_Q['time_words']} THEN 'trend' WHEN {_Q['personal']} THEN 'personal' ELSE 'rag_only' END"
PRONOUNS = _any("lower(text)", search.PRONOUNS)
OLDER = f"CASE WHEN {_any('q', ['ung', 'ow'])} THEN 'invalid' WHEN {_any('q', ['hello', 'ing'])} THEN 'greeting' WHEN {_any('q', ['der '])} THEN 'trend_analysis' WHEN {_any('q', ['the '])} THEN 'relational' WHEN {_any('q', ['e'])} THEN 'personal_info' ELSE 'rag_only' END"

GAP = "chr(10) || chr(10)"

ENTRIES = {
    "question_route": (question_route, f"WITH c AS (SELECT conv_id, turn, lower(substr(trim(text), 1, 500)) AS q, lower(text) AS t FROM conversations WHERE role = 'user'), k AS (SELECT *, {KIND} AS kind, {_any('t', WORDS['greetings'])} AND NOT {_any('t', WORDS['question_words'])} AS hello FROM c) SELECT conv_id, turn, kind, CASE WHEN hello THEN 'greeting' WHEN kind = 'invalid' THEN 'invalid' WHEN kind = 'trend' THEN 'status' WHEN kind = 'personal' AND turn > 2 THEN 'status' WHEN conv_id % 2 = 0 THEN 'rag' ELSE 'guidance' END AS route FROM k"),
    "canned_answer": (canned_answer, "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'thing') THEN 'one' WHEN contains(lower(text), 'tion') THEN 'two' WHEN contains(lower(text), 'und') THEN 'three' WHEN contains(lower(text), 'est') THEN 'complications' ELSE 'default' END AS topic FROM conversations WHERE role = 'user'"),
    "first_time_flags": (first_time_flags, "WITH f AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') = 0 AS first_time, coalesce(bool_or(role = 'assistant' AND (contains(lower(text), 'thing') OR contains(lower(text), 'nicht'))), false) AS has_previous_trend FROM conversations GROUP BY conv_id) SELECT *, CASE WHEN first_time THEN '' WHEN has_previous_trend THEN 'Lần trước, tôi đã phân tích xu hướng cho bạn.' ELSE 'Bạn đã hỏi trước đó, nhưng chưa phân tích xu hướng chi tiết.' END AS note FROM f"),
    "history_oldest20": (history_oldest20, "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'ai' END AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations QUALIFY rn <= 20"),
    "history_last10": (history_last10, "WITH r AS (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM r"),
    "history_lines": (history_lines, "SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id"),
    "rag_prompts": (rag_prompts, f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), h AS (SELECT conv_id, string_agg('- ' || CASE WHEN role = 'user' THEN '{dialogue.RAG_ASKED}' ELSE '{dialogue.RAG_ANSWERED}' END || ': ' || text, chr(10) ORDER BY n) FILTER (WHERE n <= 4) AS lines, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS q, count(*) FILTER (WHERE role = 'user') > 0 AS asked FROM r GROUP BY conv_id) SELECT conv_id, md5(trim('system' || chr(10) || chr(10) || '{dialogue.RAG_HISTORY}' || chr(10) || lines || chr(10) || chr(10) || '{dialogue.RAG_QUESTION}' || chr(10) || chr(34) || q || chr(34) || chr(10) || chr(10) || CASE WHEN conv_id % 2 = 0 AND asked THEN '{dialogue.RAG_EVIDENCE}' || chr(10) || 'about ' || q ELSE '{dialogue.RAG_NOTHING}' END)) AS prompt_md5 FROM h"),
    "trend_prompts": (trend_prompts, f"WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) SELECT c_custkey, md5('system' || {GAP} || CASE WHEN c_custkey % 2 <> 0 THEN '{dialogue.TREND_AGAIN}' WHEN c_custkey % 90 >= 50 THEN '{dialogue.TREND_OLDER[0]}' || c_name || ',' ELSE '{dialogue.TREND_YOUNGER[0]}' || c_name || ',' END || {GAP} || '{dialogue.TREND_PATIENT}' || chr(10) || c_mktsegment || {GAP} || '{dialogue.TREND_DATA}' || chr(10) || n || ' orders' || {GAP} || CASE WHEN c_custkey % 3 = 0 THEN '{dialogue.TREND_NOTES}' || chr(10) || 'last ' || last || {GAP} ELSE '' END || '{dialogue.TREND_QUESTION}' || CASE WHEN c_custkey % 90 >= 50 THEN '{dialogue.TREND_OLDER[1]}' ELSE '{dialogue.TREND_YOUNGER[1]}' END || chr(10) || chr(34) || 'how is ' || c_name || chr(34) || {GAP} || '### end') AS prompt_md5 FROM customer JOIN o ON o_custkey = c_custkey"),
    "last_user_message": (last_user_message, "SELECT conv_id, md5(arg_max(text, turn) FILTER (WHERE role = 'user')) AS question_md5 FROM conversations GROUP BY conv_id"),
    "rewrite_gate": (rewrite_gate, f"WITH c AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) SELECT conv_id, n >= 2 AND {PRONOUNS} AS rewrite FROM c"),
    "role_normalised": (role_normalised, "SELECT CASE WHEN lower(role) = 'user' THEN 'user' ELSE 'ai' END AS role, count(*) AS n FROM conversations GROUP BY 1"),
    "session_messages": (session_messages, "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id"),
    "result_json": (result_json, "SELECT '{\"conv_id\":' || conv_id || ',\"turn\":' || turn || ',\"role\":\"' || role || '\"}' AS json FROM conversations"),
    "older_labels": (older_labels, f"WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, {OLDER} AS label FROM c"),
}

"""Queries that change collections, and rules that other queries don't show, each over whole tables.

Documents stand for a service's documents, their languages for knowledge bases, their lines for chunks; conversations
stand for sessions of as many users as there are remainders of 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.operators import dialogue, health, mutations
from tarnlake.operators.chunking import chunk_stats_of
from tarnlake.plans.readings import anchor_of
from tarnlake.session import table
from tarnlake.streaming.jobs import dedupe_contents

GONE_DOCUMENT, GONE_KNOWLEDGE, USERS = "3", "en", 7
OLD, NEW = "timestamp_ntz'2024-01-01 00:00:00'", "timestamp_ntz'2024-02-01 00:00:00'"


def service_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The collections of the service, from documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("knowledge_id"), F.col("n_chars").alias("file_size_bytes"), "text")
    lines = d.select(F.col("_id").alias("document_id"), "knowledge_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    chunks = lines.select(F.concat_ws("-", "document_id", "pos").alias("_id"), "document_id", "knowledge_id")
    meta = F.struct(F.col("_id").alias("document_chunk_id"), "document_id")
    points = chunks.select(F.col("_id").alias("id"), "knowledge_id", F.struct(meta.alias("metadata")).alias("payload"))
    jobs = d.select(F.col("_id").alias("document_id"), "knowledge_id", F.lit("normal").alias("document_status"))
    knowledges = d.select(F.col("knowledge_id").alias("_id")).distinct()
    settings = knowledges.agg(F.array_sort(F.collect_set("_id")).alias("list_knowledge_ids"))
    return {"documents": d.drop("text"), "document_chunks": chunks, "points": points, "document_jobs": jobs, "knowledges": knowledges, "settings": settings}


def document_deleted(spark, sf_dir):
    """One document deleted with all that hangs on it: of each knowledge base the new statistics and what is left."""
    t = mutations.delete_document(service_tables(spark, sf_dir), GONE_DOCUMENT)
    out = t["knowledges"]
    for name in ("document_chunks", "points"):
        out = out.join(t[name].groupBy(F.col("knowledge_id").alias("_id")).agg(F.count("*").alias(name)), "_id", "left")
    jobs = t["document_jobs"].groupBy(F.col("knowledge_id").alias("_id")).agg(F.count_if(F.col("document_status") == "deleted").alias("deleted_jobs"))
    return out.join(jobs, "_id", "left").select("_id", "document_count", "total_size_bytes", "document_chunks", "points", "deleted_jobs")


def knowledge_deleted(spark, sf_dir):
    """A knowledge base deleted: the rows left in every collection, and the settings' list."""
    t = mutations.delete_knowledge(service_tables(spark, sf_dir), GONE_KNOWLEDGE)
    out = t["settings"].select(F.lit("settings").alias("collection"), F.size("list_knowledge_ids").cast("bigint").alias("n"))
    for name in ("knowledges", "documents", "document_chunks", "points", "document_jobs"):
        out = out.unionByName(t[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n"))
    return out


def _sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    user = F.concat(F.lit("u"), (F.col("conv_id") % USERS).cast("string"))
    messages = c.select(F.col("conv_id").cast("string").alias("session_id"), user.alias("user_id"), "turn", "role", F.col("text").alias("content"), F.expr(OLD).alias("created_at"))
    sessions = messages.select(F.col("session_id").alias("_id"), "user_id").distinct().withColumns({"title": F.concat(F.lit("s"), "_id"), "updated_at": F.expr(OLD)})
    return sessions, messages


def sessions_changed(spark, sf_dir):
    """New sessions (those whose title a user has already are refused), one renamed, one deleted with its messages."""
    sessions, messages = _sessions(spark, sf_dir)
    taken = sessions.select(F.concat(F.lit("n"), "_id").alias("_id"), "user_id", "title", "updated_at")
    new = taken.unionByName(sessions.select(F.concat(F.lit("m"), "_id").alias("_id"), "user_id", F.concat(F.lit("new "), "title").alias("title"), "updated_at"))
    sessions = mutations.update_session(mutations.create_session(sessions, new), "2", title="renamed")
    sessions, messages = mutations.delete_session(sessions, messages, "4")
    counts = messages.groupBy(F.col("session_id").alias("_id")).agg(F.count("*").alias("messages"))
    return sessions.join(counts, "_id", "left").select("_id", "user_id", "title", F.coalesce("messages", F.lit(0)).alias("messages"))


def messages_appended(spark, sf_dir):
    """A message appended to each session that ends with the user: the sessions' sizes and times."""
    sessions, messages = _sessions(spark, sf_dir)
    last = messages.groupBy("session_id", "user_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn")).filter("role = 'user'")
    new = last.select("session_id", "user_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), F.lit("answer").alias("content"), F.expr(NEW).alias("created_at"))
    messages, sessions = mutations.append_messages(messages, sessions, new)
    counts = messages.groupBy(F.col("session_id").alias("_id")).agg(F.count("*").alias("messages"))
    return sessions.join(counts, "_id").select("_id", "messages", (F.col("updated_at") == F.expr(NEW)).alias("touched"))


def user_messages_deleted(spark, sf_dir):
    _, messages = _sessions(spark, sf_dir)
    left = mutations.delete_user_messages(messages, "u3")
    return left.groupBy("user_id").agg(F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions"))


def session_targets(spark, sf_dir):
    """The session that each user's newest message goes to: its own one if it is that user's, else a new one; the admin's one."""
    sessions, messages = _sessions(spark, sf_dir)
    sessions = sessions.withColumn("user_id", F.when(F.col("_id").cast("int") % 3 == 0, "admin").otherwise(F.col("user_id")))
    m = messages.filter("turn = 0").withColumn("user_id", F.when(F.col("session_id").cast("int") % 5 == 0, "admin").otherwise(F.col("user_id")))
    out = dialogue.sessions_for(m.select("user_id", "session_id", "content"), sessions)
    return out.select("session_id", "user_id", F.when(F.col("is_new"), "").otherwise(F.col("target_session")).alias("kept_session"), "is_new", F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"))


def admin_history(spark, sf_dir):
    """Messages of the user admin, whatever the session, and of one session for others."""
    _, messages = _sessions(spark, sf_dir)
    m = messages.select(F.concat_ws("-", "session_id", F.lpad(F.col("turn").cast("string"), 4, "0")).alias("_id"), F.when(F.col("user_id") == "u1", "admin").otherwise(F.col("user_id")).alias("user_id"), "session_id", "created_at")
    every = dialogue.history_of(m, user="admin").select(F.lit("admin").alias("asked"), "_id")
    return every.unionByName(dialogue.history_of(m, session="2").select(F.lit("2").alias("asked"), "_id"))


def status_answers(spark, sf_dir):
    """The answer that each customer's question gets, from all events: purchases stand for glucose, views for pressure."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view"))
    kind = F.when(F.col("event_type") == "purchase", health.GLUCOSE).otherwise(health.PRESSURE)
    part = F.when(F.col("event_type") == "purchase", "").when(F.col("event_id") % 2 == 0, health.SYSTOLIC).otherwise(health.DIASTOLIC)
    readings = e.select(F.col("user_id"), kind.alias("type"), part.alias("subtype"), "value", F.col("ts").alias("timestamp"), F.col("event_id").alias("_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    texts = F.array(*map(F.lit, ["huyết áp gần đây", "đường huyết xu hướng", "dạo này", "ăn gì"]))
    questions = c.select("user_id", F.get(texts, (F.col("user_id") % 4).cast("int")).alias("question"))
    out = health.status_responses(questions, c.filter("user_id % 10 <> 7"), readings, anchor_of(table(spark, sf_dir, "events")))
    return out.select("user_id", "case", F.col("summary").isNull().alias("no_summary"))


def text_rules(spark, sf_dir):
    """Cuts, tags and number formats on every message."""
    c = table(spark, sf_dir, "conversations")
    tagged = F.concat(F.lit(" [HEADING]"), "role", F.lit("[/HEADING]\n"))
    value = (F.col("conv_id") * 10 + F.col("turn")) / 8.0
    return c.select("conv_id", "turn", F.md5(T.cut(F.col("text"), 100)).alias("cut_md5"), T.strip_heading_tags(tagged).alias("stripped"), T.format_number(value, F.lit(1)).alias("one"), T.format_number(value, F.lit(0)).alias("whole"))


def heading_rules(spark, sf_dir):
    """The heading tests of DOCX and PDF and the validity of headings on every line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    style = F.when(F.col("pos") % 5 == 0, "Heading 2").when(F.col("pos") % 5 == 1, "Title").otherwise("Normal")
    size = F.array((F.col("pos") % 3 + 13).cast("double"), F.lit(15.0))
    font = F.array(F.when(F.col("pos") % 4 == 0, "Arial-Bold").otherwise("Arial"))
    rows = lines.select("doc_id", "pos", T.is_docx_heading(style, F.col("line")).alias("docx"), T.is_pdf_heading(size, font).alias("pdf"), T.is_valid_heading(F.col("line")).alias("valid"))
    return rows.groupBy("doc_id").agg(F.count_if("docx").alias("docx"), F.count_if("pdf").alias("pdf"), F.count_if("valid").alias("valid"))


def chunk_statistics(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("content")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(lines, lambda x: F.trim(x["content"]) != "").alias("chunks"))
    return chunk_stats_of(d, "chunks").select("doc_id", "pos", "chunk_index", "chunk_count", "word_count")


def duplicate_uploads(spark, sf_dir):
    """Every document as a file, those of German known already: which are new, and which are duplicates."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").cast("binary").alias("content"))
    known = d.filter("lang = 'de'").select(F.md5(F.col("text").cast("binary")).alias("file_hash"))
    new, duplicates = dedupe_contents(files, known)
    return new.select("path", "file_hash", F.lit(True).alias("is_new")).unionByName(duplicates.select("path", "file_hash", F.lit(False).alias("is_new")))


D = "d AS (SELECT doc_id::VARCHAR AS id, lang AS k, n_chars AS b, text FROM documents)"
K = "c AS (SELECT id, k, unnest(string_split(text, chr(10))) AS line FROM d)"
S = f"m AS (SELECT conv_id::VARCHAR AS session_id, 'u' || (conv_id % {USERS}) AS user_id, turn, role, text AS content FROM conversations), s AS (SELECT DISTINCT session_id AS id, user_id FROM m)"
L = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
SPACES = r"[\s\x{0085}\p{Z}]+"
RECENT = "a AS (SELECT max(ts) AS newest FROM events), e AS (SELECT user_id, event_type = 'purchase' AS g, event_id % 2 = 0 AS sys, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events, a WHERE event_type IN ('purchase', 'view') AND ts >= newest - INTERVAL 7 DAY)"

ENTRIES = {
    "document_deleted": (document_deleted, f"WITH {D}, {K}, n AS (SELECT k, count(*) AS lines FROM c WHERE id <> '{GONE_DOCUMENT}' GROUP BY k) SELECT d.k AS _id, count(*) FILTER (WHERE id <> '{GONE_DOCUMENT}') AS document_count, coalesce(sum(b) FILTER (WHERE id <> '{GONE_DOCUMENT}'), 0)::BIGINT AS total_size_bytes, max(lines) AS document_chunks, max(lines) AS points, count(*) FILTER (WHERE id = '{GONE_DOCUMENT}') AS deleted_jobs FROM d LEFT JOIN n ON n.k = d.k GROUP BY d.k"),
    "knowledge_deleted": (knowledge_deleted, f"WITH {D}, {K} SELECT 'settings' AS collection, count(DISTINCT k) AS n FROM d WHERE k <> '{GONE_KNOWLEDGE}' UNION ALL SELECT 'knowledges', count(DISTINCT k) FROM d WHERE k <> '{GONE_KNOWLEDGE}' UNION ALL SELECT unnest(['documents', 'document_jobs']), count(*) FROM d WHERE k <> '{GONE_KNOWLEDGE}' UNION ALL SELECT unnest(['document_chunks', 'points']), count(*) FROM c WHERE k <> '{GONE_KNOWLEDGE}'"),
    "sessions_changed": (sessions_changed, f"WITH {S}, n AS (SELECT session_id, count(*) AS messages FROM m GROUP BY session_id) SELECT id AS _id, user_id, CASE WHEN id = '2' THEN 'renamed' ELSE 's' || id END AS title, messages FROM s JOIN n ON n.session_id = id WHERE id <> '4' UNION ALL SELECT 'm' || id, user_id, 'new s' || id, 0 FROM s"),
    "messages_appended": (messages_appended, f"WITH {S}, n AS (SELECT session_id, count(*) AS n, arg_max(role, turn) = 'user' AS asked FROM m GROUP BY session_id) SELECT session_id AS _id, n + CASE WHEN asked THEN 1 ELSE 0 END AS messages, asked AS touched FROM n"),
    "user_messages_deleted": (user_messages_deleted, f"WITH {S} SELECT user_id, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM m WHERE user_id <> 'u3' GROUP BY user_id"),
    "session_targets": (session_targets, f"WITH {S}, o AS (SELECT id, CASE WHEN id::INT % 3 = 0 THEN 'admin' ELSE user_id END AS owner FROM s), q AS (SELECT session_id, CASE WHEN session_id::INT % 5 = 0 THEN 'admin' ELSE user_id END AS user_id, content FROM m WHERE turn = 0), j AS (SELECT q.*, CASE WHEN q.user_id = 'admin' THEN (SELECT min(id) FROM o WHERE owner = 'admin') WHEN o.owner = q.user_id THEN o.id END AS kept FROM q LEFT JOIN o ON o.id = q.session_id) SELECT session_id, user_id, coalesce(kept, '') AS kept_session, kept IS NULL AS is_new, md5(CASE WHEN kept IS NULL THEN substr(content, 1, 100) ELSE '' END) AS title_md5 FROM j"),
    "admin_history": (admin_history, f"WITH {S}, i AS (SELECT session_id || '-' || lpad(turn::VARCHAR, 4, '0') AS id, user_id, session_id FROM m) SELECT 'admin' AS asked, id AS _id FROM i WHERE user_id = 'u1' UNION ALL SELECT '2', id FROM i WHERE session_id = '2'"),
    "status_answers": (status_answers, f"WITH {RECENT}, f AS (SELECT user_id, coalesce(bool_or(g AND rn <= 5), false) AS g, coalesce(bool_or(NOT g AND rn <= 5), false) AS p, coalesce(bool_or(NOT g AND sys AND rn <= 5), false) AS s FROM e GROUP BY user_id), c AS (SELECT c_custkey AS user_id, c_custkey % 10 <> 7 AS known, coalesce(g, false) AS g, coalesce(p, false) AS p, coalesce(s, false) AS s, c_custkey % 4 AS q FROM customer LEFT JOIN f ON f.user_id = c_custkey), k AS (SELECT *, CASE WHEN q = 3 THEN 'general_knowledge' WHEN NOT known THEN 'no_profile' WHEN NOT g AND NOT p THEN 'no_data' WHEN q = 0 THEN CASE WHEN s THEN 'pressure' ELSE 'no_systolic' END WHEN q = 1 THEN CASE WHEN g THEN 'glucose' ELSE 'no_glucose' END ELSE 'both' END AS \"case\" FROM c) SELECT user_id, \"case\", \"case\" NOT IN ('pressure', 'glucose', 'both') AS no_summary FROM k"),
    "text_rules": (text_rules, "SELECT conv_id, turn, md5(substr(trim(text), 1, 100)) AS cut_md5, role AS stripped, format('{:.1f}', (conv_id * 10 + turn) / 8.0::DOUBLE) AS one, format('{:.0f}', (conv_id * 10 + turn) / 8.0::DOUBLE) AS whole FROM conversations"),
    "heading_rules": (heading_rules, f"WITH {L} SELECT doc_id, count(*) FILTER (WHERE pos % 5 < 2 OR (length(line) < 100 AND line = upper(line) AND regexp_full_match(line, '\\p{{L}}+'))) AS docx, count(*) FILTER (WHERE (pos % 3 + 13 + 15) / 2.0 > 14 OR pos % 4 = 0) AS pdf, count(*) FILTER (WHERE trim(line) <> '' AND length(line) <= 100 AND NOT regexp_matches(lower(line), '{'|'.join(T.HEADING_NOISE)}') AND length(line) - length(replace(line, ',', '')) <= 1 AND NOT contains(line, '.')) AS valid FROM l GROUP BY doc_id"),
    "chunk_statistics": (chunk_statistics, f"WITH {L} SELECT doc_id, pos::INT AS pos, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_count, len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda w: w <> ''))::INT AS word_count FROM l WHERE trim(line, ' ') <> ''"),
    "duplicate_uploads": (duplicate_uploads, "WITH h AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS path, md5(text) AS file_hash, lang FROM documents) SELECT path, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY path) = 1 AND NOT coalesce(bool_or(lang = 'de') OVER (PARTITION BY file_hash), false) AS is_new FROM h"),
}

"""Question routing and canned answers of the chat service, by keyword rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import contains_any

# Keyword lists of the rules.
GREETINGS = ["xin chào", "chào bạn", "chào bác", "hello", "hi ", "chào mừng"]
QUESTION_WORDS = ["muốn biết", "là gì", "gì không", "có gì", "bao gồm", "thế nào", "như thế nào", "gồm những gì"]
TIME_WORDS = ["gần đây", "xu hướng", "thay đổi", "so sánh", "dạo này", "tuần trước"]
PERSONAL = ["tôi bị", "của tôi", "tình trạng của tôi", "chỉ số của tôi", "tôi đang", "tôi cảm thấy", "tui muốn biết", "tôi muốn hỏi"]
HEALTH = ["đường huyết", "huyết áp", "tiểu đường", "insulin", "sức khỏe", "chỉ số"]
DISEASES = ["tiểu đường", "ung thư", "tim mạch", "bệnh gan", "bệnh thận"]
COMPARISONS = ["loại nào", "cái nào", "so sánh", "khác nhau", "nguy hiểm hơn", "tốt hơn"]
INVALID = ["chết", "tự tử", "bỏ thuốc", "không sống", "mệt quá"]
GENERAL = ["là gì", "gì là", "bao gồm những gì", "tổng quan"]
PREVIOUS_TREND = ["xu hướng", "gần đây", "phân tích", "đánh giá"]
CANNED_DISEASES = [("ung thư", "ung thư"), ("tim mạch", "bệnh tim"), ("gan", "bệnh gan"), ("thận", "bệnh thận")]
COMPLICATIONS = ["biến chứng", "nguy hiểm", "hậu quả"]
# The older rule set, in the order in which its labels are tried.
OLDER_RULES = [
    ("invalid", ["chết", "bỏ thuốc", "mệt quá"]),
    ("greeting", ["chào", "hello"]),
    ("trend_analysis", ["gần đây", "xu hướng"]),
    ("relational", ["so với", "liên quan"]),
    ("personal_info", ["của tôi", "tình trạng tôi"]),
]
OLDER_LABELS = ["greeting", "invalid", "personal_info", "trend_analysis", "relational", "rag_only"]
# Notes on what was said before, and the prompt's label.
NOTE_TREND = "Lần trước, tôi đã phân tích xu hướng cho bạn."
NOTE_ASKED = "Bạn đã hỏi trước đó, nhưng chưa phân tích xu hướng chi tiết."
QUESTION_LABEL = "Câu hỏi: "
# The parts of the prompt that the service renders for a question with documents.
RAG_HISTORY, RAG_QUESTION, RAG_EVIDENCE = "### Ngữ cảnh trước đó", "### Câu hỏi", "### Bằng chứng y khoa"
RAG_ASKED, RAG_ANSWERED, RAG_NOTHING = "Người hỏi", "Trả lời", "Không có tài liệu liên quan đến câu hỏi này."

DEFAULT_WORDS = {"greetings": GREETINGS, "question_words": QUESTION_WORDS, "time_words": TIME_WORDS, "personal": PERSONAL, "health": HEALTH, "diseases": DISEASES, "comparisons": COMPARISONS, "invalid": INVALID}


def is_greeting(question: Column, greetings: list[str] = [*GREETINGS, "chào buổi"], question_words: list[str] = QUESTION_WORDS) -> Column:  # noqa: B006
    return contains_any(question, greetings) & ~contains_any(question, question_words)


def classify(question: Column, label: Column | None = None, words: dict[str, list[str]] | None = None) -> Column:
    """rag_only, trend, personal or invalid: rules first, then a model's label (null without a model), then a fallback."""
    w = DEFAULT_WORDS | (words or {})
    q = F.substring(F.trim(question), 1, 500)
    has = {k: contains_any(q, v) for k, v in w.items()}
    rules = (
        F.when(has["greetings"] & ~has["question_words"], "rag_only")
        .when(has["diseases"] & has["comparisons"], "rag_only")
        .when(has["time_words"] & has["health"], "trend")
        .when(has["personal"] & has["health"], "personal")
    )
    fallback = F.when(has["invalid"], "invalid").when(has["time_words"], "trend").when(has["personal"], "personal").otherwise("rag_only")
    if label is None:
        return F.coalesce(rules, fallback)
    named = F.lower(F.trim(label))
    # a model's "personal" needs both word groups, which the rules have found already where they are
    model = F.when(named == "personal", "rag_only").when(named.isin("rag_only", "trend", "invalid"), named)
    return F.coalesce(rules, model, fallback)


def route(kind: Column, has_context: Column, has_documents: Column, greeting: Column) -> Column:
    """The responder of a message."""
    general = F.when(has_documents, "rag").otherwise("guidance")
    return (
        F.when(greeting, "greeting").when(kind == "invalid", "invalid").when(kind == "trend", "status")
        .when(kind == "personal", F.when(has_context, "status").otherwise(general)).otherwise(general)
    )


def canned_topic(question: Column, diseases: list[tuple[str, str]] = CANNED_DISEASES, complications: list[str] = COMPLICATIONS) -> Column:
    """The canned answer to give: the first disease named, complications, or default."""
    out = None
    for word, name in diseases:
        hit = contains_any(question, [word])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    some = contains_any(question, complications)
    return (F.when(some, "complications") if out is None else out.when(some, "complications")).otherwise("default")


def history_flags(messages: DataFrame, session: str, role: str = "role", text: str = "text", ai: str = "assistant", words: list[str] = PREVIOUS_TREND) -> DataFrame:
    """first_time (no answer yet) and has_previous_trend (an answer has one of the words) of each session."""
    mine = F.lower(role) == ai
    return messages.groupBy(session).agg((F.count_if(mine) == 0).alias("first_time"), F.coalesce(F.bool_or(mine & contains_any(F.col(text), words)), F.lit(False)).alias("has_previous_trend"))


def history_note(first_time: Column, has_previous_trend: Column) -> Column:
    return F.when(first_time, "").when(has_previous_trend, NOTE_TREND).otherwise(NOTE_ASKED)


def sessions_for(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """messages (user_id, session_id, content) with the session they go to: admin's one session, the given one if it
    exists, else a new one (stable id) titled with the content's first 100 characters."""
    own = sessions.groupBy("user_id").agg(F.min("_id").alias("_admin"))
    m = messages.join(own, "user_id", "left").join(sessions.select(F.col("_id").alias("_found"), F.col("user_id").alias("_owner")), (F.col("session_id") == F.col("_found")) & (F.col("user_id") == F.col("_owner")), "left")
    kept = F.when(F.col("user_id") == "admin", F.col("_admin")).otherwise(F.col("_found"))
    fresh = F.substring(F.sha2(F.concat_ws("\x01", "user_id", F.coalesce("session_id", F.lit("")), "content"), 256), 1, 24)
    return m.select(*messages.columns, F.coalesce(kept, fresh).alias("target_session"), kept.isNull().alias("is_new"), F.when(kept.isNull(), F.substring("content", 1, 100)).alias("title"))


def history_of(messages: DataFrame, user: str | None = None, session: str | None = None) -> DataFrame:
    """A session's messages, or all of the user admin's, oldest first."""
    rows = messages.filter(F.col("user_id") == user) if user == "admin" else messages.filter(F.col("session_id") == session)
    return rows.orderBy(F.col("created_at").asc(), "_id")


def older_label(question: Column, label: Column | None = None, rules: list[tuple[str, list[str]]] = OLDER_RULES) -> Column:
    """Labels of the service's older handler: a model's answer if there is one (rag_only for any it doesn't know), else
    the first of its own short keyword rules that holds, else rag_only."""
    found = reduce(lambda x, rule: F.coalesce(x, F.when(contains_any(question, rule[1]), rule[0])), rules, F.lit(None).cast("string"))
    found = F.coalesce(found, F.lit("rag_only"))
    if label is None:
        return found
    named = F.lower(F.trim(label))
    return F.when(label.isNull(), found).when(named.isin(OLDER_LABELS), named).otherwise("rag_only")


def rag_prompt(question: Column, contexts: Column, history: Column, most: int = 4) -> Column:
    """The text given to a model: documents, the last turns, the question."""
    last = F.slice(history, F.greatest(F.size(history) - most + 1, F.lit(1)), most)
    return F.concat_ws("\n\n", F.array_join(F.filter(contexts, lambda c: F.trim(c) != ""), "\n"), F.array_join(last, "\n"), F.concat(F.lit(QUESTION_LABEL), question))


def render_rag(system: Column, question: Column, contexts: Column, history: Column, guidance: str = "", most: int = 4) -> Column:
    """The service's template for a question with documents: system prompt, the last `most` turns of history (array of
    role and content, oldest first) from the newest on, the question, the evidence or a note that there is none, and
    guidance. Parts without content are left out; contexts is one text, null or empty if there is none."""
    turns = F.reverse(F.slice(history, F.greatest(F.size(history) - most + 1, F.lit(1)), most))
    line = lambda m: F.concat(F.lit("- "), F.when(m["role"] == "user", RAG_ASKED).otherwise(RAG_ANSWERED), F.lit(": "), F.coalesce(m["content"], F.lit("")))
    before = F.when(F.size(history) > 0, F.concat_ws("\n", F.lit(RAG_HISTORY), F.array_join(F.transform(turns, line), "\n")))
    evidence = F.when(F.coalesce(contexts, F.lit("")) != "", F.concat_ws("\n", F.lit(RAG_EVIDENCE), contexts)).otherwise(RAG_NOTHING)
    asked = F.concat(F.lit(f'{RAG_QUESTION}\n"'), question, F.lit('"'))
    return F.trim(F.concat_ws("\n\n", F.nullif(system, F.lit("")), before, asked, evidence, F.lit(guidance or None)))


# The parts of the template for a question about trends.
TREND_OLDER, TREND_YOUNGER, TREND_AGAIN = ("Chào bác ", "bác"), ("Chào anh/chị ", "anh/chị"), "Dạ, theo dõi gần đây,"
TREND_PATIENT, TREND_DATA, TREND_NOTES, TREND_QUESTION = "### Thông tin bệnh nhân", "### Dữ liệu sức khỏe", "### Ghi chú theo dõi", "### Câu hỏi của "


def render_trend(system: Column, question: Column, full_name: Column, age: Column, patient: Column, summary: Column, notes: Column, first_time: Column, guidance: str = "") -> Column:
    """The service's template for a question about trends: system prompt, a greeting by age the first time and a link to what was said
    else, what is known of the patient, the data, notes if there are any, the question and guidance. A null age is a younger one's."""
    older = F.coalesce(age >= 50, F.lit(False))
    greeting, name = (F.when(older, TREND_OLDER[i]).otherwise(TREND_YOUNGER[i]) for i in (0, 1))
    opening = F.when(F.coalesce(first_time, F.lit(False)), F.concat(greeting, F.coalesce(full_name, F.lit("")), F.lit(","))).otherwise(TREND_AGAIN)
    part = lambda head, body: F.concat(F.lit(f"{head}\n"), F.coalesce(body, F.lit("")))
    noted = F.when(F.coalesce(notes, F.lit("")) != "", part(TREND_NOTES, notes))
    asked = F.concat(F.lit(TREND_QUESTION), name, F.lit('\n"'), F.coalesce(question, F.lit("")), F.lit('"'))
    return F.trim(F.concat_ws("\n\n", F.nullif(system, F.lit("")), opening, part(TREND_PATIENT, patient), part(TREND_DATA, summary), noted, asked, F.lit(guidance or None)))


def address(age: Column) -> Column:
    """How to address a person of this age."""
    return F.when(age >= 50, "bác").otherwise("bạn")

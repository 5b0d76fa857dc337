"""Golden cases worked out by hand from the services' rules."""

import hashlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument
from tarnlake.functions import text as T
from tarnlake.functions.registry import TimedCache, cached, embedder, generator, register_sql
from tarnlake.functions.vectors import cosine, cosine_to, cosines_to
from tarnlake.operators import dialogue, health, paging, predicates, relational, scoring, search
from tarnlake.operators.chunking import Packer, structure
from tarnlake.sources import fixtures

ANCHOR = datetime(2024, 5, 8, 12)


def value(spark, text, fn, *more):
    df = spark.createDataFrame([(text, *more)], ["c", *[f"x{i}" for i in range(len(more))]] if more else "c string")
    return df.select(fn(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    "before, after",
    [
        ("a [ 3 ] b", "a b"), ("see https://x.example/á?b=1 end", "see end"), ("x 2:15 PM Tiểu - Wikipedia y", "x y"), ("p /25, 2:15 q", "p q"),
        ("bệ-\nnh", "bệnh"), ("ab\ncd", "ab cd"), ("a   b", "a b"), ("é", "é"), ("", ""), (None, ""),
    ],
)
def test_clean_text(spark, before, after):
    assert value(spark, before, T.clean_text) == after


def test_noise(spark):
    nine, ten = "w " * 9, "w " * 10
    cases = {nine: True, ten: False, "a|b|c|d|e " + "w " * 9: True, "a|b|c|d " + "w " * 9: False, ten + "Wikipedia": True, ten + "https://x Wikipedia": False}
    assert {k: value(spark, k, T.is_noisy) for k in cases} == cases


def test_compressible(spark):
    check = lambda name, size: value(spark, name, T.should_compress, size)
    assert [check("a.txt", 1023), check("a.txt", 1024), check("a.pdf", 5000), check("a", 5000), check("A.JSON", 5000)] == [False, True, False, False, True]


def test_headings(spark):
    assert value(spark, "TIỂU ĐƯỜNG", T.is_txt_heading) and value(spark, "ghi chú:", T.is_txt_heading) and not value(spark, "Thường", T.is_txt_heading)
    assert value(spark, "Điều trị", T.is_valid_heading) and not value(spark, "Bệnh là một", T.is_valid_heading) and not value(spark, "a.b", T.is_valid_heading)
    assert value(spark, "x mới chọn: y", T.is_noise_block)
    assert value(spark, "các loại đái tháo đ", lambda a: T.cuts_phrase(a, F.lit("ường và insulin"))) and not value(spark, "các loại đái tháo", lambda a: T.cuts_phrase(a, F.lit("đường và insulin"))) and not value(spark, "một", lambda a: T.cuts_phrase(a, F.lit("hai")))


def test_guard(spark):
    cases = {"": T.GUARD_EMPTY, "import os": T.GUARD_CODE, "I think so": T.GUARD_ENGLISH, "let me think\nx\n### A\nb": "### A\nb", "phân tích": T.GUARD_NOTHING, "Chào bạn": "Chào bạn"}
    assert {k: value(spark, k, T.guard_answer) for k in cases} == cases


def test_number_format_is_half_even(spark):
    assert [value(spark, x, lambda c, d: T.format_number(c, d), n) for x, n in ((8.25, 1), (142.5, 0), (8.35, 1))] == ["8.2", "142", f"{8.35:.1f}"]


@pytest.mark.parametrize("text, score", [("insulin", 0.48), ("hba1c insulin", 1.0), ("không dùng insulin", 0.0), ("nothing here", 0.0), ("", 0.0), ("glucose", 0.12)])
def test_lexicon(spark, text, score):
    assert value(spark, text, scoring.relevance) == score


def test_lexicon_with_model(spark):
    got = value(spark, "glucose level", lambda c: F.array(scoring.relevance(c, F.lit(0.5)), scoring.relevance(c, F.lit(0.9), F.lit(0.7))))
    assert got == [0.8, 0.0]


@pytest.mark.parametrize("newest, oldest, n, word", [(7.0, 7.0, 2, "ổn định"), (7.0, 7.0, 1, "ổn định"), (9.2, 9.5, 3, "giảm"), (7.8, 7.6, 3, "tăng")])
def test_trend(spark, newest, oldest, n, word):
    assert value(spark, newest, health.trend, oldest, n) == word


def test_bands(spark):
    assert [value(spark, x, health.glucose_band) for x in (8.0, 8.01, 6.0)] == ["medium", "high", "low"]
    assert [value(spark, float(a), health.pressure_band, float(b)) for a, b in ((140, 90), (141, 80), (120, 81), (120, 80), (118, 0))] == ["borderline", "high", "borderline", "stable", "stable"]


def test_people(spark):
    r, p = fixtures.readings(spark, ANCHOR), fixtures.profiles(spark)
    g = {x.user_id: (round(x.mean_value, 4), x.latest, x.trend, x.band) for x in health.glucose_summary(health.recent_readings(r, F.lit(ANCHOR), 5, [health.GLUCOSE]), "user_id").collect()}
    assert g == {"user_001": (9.1333, 9.2, "giảm", "high"), "user_002": (7.8333, 7.8, "tăng", "medium")}
    b = {x.user_id: (x.mean_systolic, x.mean_diastolic, x.latest, x.trend, x.band) for x in health.pressure_summary(health.recent_readings(r, F.lit(ANCHOR), 5, [health.PRESSURE]), "user_id").collect()}
    assert b == {"user_001": (143.5, 90.0, 145.0, "tăng", "high"), "user_002": (136.5, 85.0, 138.0, "tăng", "borderline")}
    q = spark.createDataFrame([("user_001", "đường huyết của tôi gần đây, insulin"), ("user_002", "huyết áp gần đây"), ("nobody", "huyết áp gần đây"), ("user_001", "ăn gì")], "user_id string, question string")
    context = {(x.user_id, x.question): x.context for x in health.profile_context(q, p, r, F.lit(ANCHOR)).collect()}
    assert context["user_001", "đường huyết của tôi gần đây, insulin"].split("\n")[1:] == ["Đường huyết: 9.2 mmol/l, 8.7 mmol/l, 9.5 mmol/l", "Biến chứng: Bệnh võng mạc", "Lịch tiêm insulin: Buổi sáng và buổi tối"]
    assert context["user_002", "huyết áp gần đây"].endswith("Huyết áp: trung bình 138 mmHg (Tâm thu)") and context["nobody", "huyết áp gần đây"] == ""
    case = {(x.user_id, x.question): x["case"] for x in health.status_responses(q, p, r, F.lit(ANCHOR)).collect()}
    assert list(case.values()).count("general_knowledge") == 1 and case["user_002", "huyết áp gần đây"] == "pressure" and case["nobody", "huyết áp gần đây"] == "no_profile"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("xin chào", "rag_only"), ("xin chào, tiểu đường là gì", "rag_only"), ("đường huyết gần đây thế nào", "trend"), ("tiểu đường và ung thư cái nào nguy hiểm hơn", "rag_only"),
        ("Tui muốn biết chỉ số đường huyết của tôi?", "personal"), ("tôi muốn tự tử", "invalid"), ("xu hướng thế nào", "trend"),
    ],
)
def test_classify(spark, text, kind):
    assert value(spark, text, dialogue.classify) == kind


def test_labels_and_routes(spark):
    assert value(spark, "thời tiết", lambda q: dialogue.classify(q, F.lit("personal"))) == "rag_only"
    assert value(spark, "thời tiết", lambda q: dialogue.classify(q, F.lit(" Trend "))) == "trend"
    assert value(spark, "xin chào", dialogue.is_greeting) and not value(spark, "xin chào, tiểu đường là gì", dialogue.is_greeting)
    assert value(spark, "ung thư gan", dialogue.canned_topic) == "ung thư"
    got = value(spark, "personal", lambda k: F.array(dialogue.route(k, F.lit(True), F.lit(True), F.lit(False)), dialogue.route(k, F.lit(False), F.lit(True), F.lit(False)), dialogue.route(k, F.lit(False), F.lit(False), F.lit(False)), dialogue.route(k, F.lit(False), F.lit(False), F.lit(True))))
    assert got == ["status", "rag", "guidance", "greeting"]


def test_older_labels(spark):
    cases = {
        "xin chào, tôi mệt quá": "invalid", "Xin chào": "greeting", "gần đây so với trước": "trend_analysis", "so với của tôi": "relational",
        "chỉ số của tôi": "personal_info", "tôi bị sốt": "rag_only", "hello, xu hướng": "greeting",
    }
    assert {q: value(spark, q, dialogue.older_label) for q in cases} == cases
    model = lambda q, label: value(spark, q, lambda c: dialogue.older_label(c, F.lit(label)))
    assert [model("xin chào", " Relational "), model("xin chào", "other"), model("xin chào", None)] == ["relational", "rag_only", "greeting"]


def test_structure_follows_the_brackets(spark):
    texts = [
        "[HEADING]a [1] b[/HEADING] c", "x [HEADING]a [1] b[/HEADING] c", "[HEADING]A\nB[/HEADING]\n\n text \x01 more[PAGE_BREAK]\n[PAGE_BREAK] [HEADING][/HEADING]",
        "no marks", "", "[HEADING]open", "[HEADING]a[/HEADING][HEADING]b[/HEADING]tail [/HEADING]",
    ]
    for t in texts:
        got = [(b.kind, b.content) for b in value(spark, t, T.blocks)]
        assert got == structure(t)
    assert structure(texts[0]) == [("heading", "a [1] b c")] and structure(texts[1]) == [("paragraph", "x [HEADING]a [1] b[/HEADING] c")]
    assert structure(texts[2])[:2] == [("heading", "A\nB"), ("paragraph", "text \x01 more")]


def test_markdown_tags(spark):
    assert value(spark, "[HEADING]A[/HEADING]text[SUBHEADING]B[/SUBHEADING]more", T.to_markdown_tags) == "### A\ntext#### B\nmore"
    assert value(spark, " [HEADING]A[/HEADING]\n", T.strip_heading_tags) == "A"


@pytest.mark.parametrize("size", [64, 768])
def test_cosines_in_one_pass(spark, size):
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(50, size)), rng.normal(size=(3, size)).tolist()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(50, None), (51, [0.0] * size), (52, [1.0])], "id int, v array<float>")
    got = {r.id: r.s for r in df.select("id", cosines_to(F.col("v"), queries).alias("s")).collect()}
    want = (rows @ np.array(queries).T) / np.linalg.norm(rows, axis=1)[:, None] / np.linalg.norm(queries, axis=1)
    assert np.allclose([got[i] for i in range(50)], want, atol=1e-6) and all(got[i] == [None] * 3 for i in (50, 51, 52))
    one = df.filter("id < 50").select(F.col("id"), cosine_to(F.col("v"), queries[1]).alias("s"), cosine(F.col("v"), F.lit(queries[1])).alias("t")).collect()
    assert all(abs(r.s - r.t) < 1e-12 and abs(r.s - want[r.id, 1]) < 1e-6 for r in one)


def test_adjacent_similarity_over_stretches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)) if i % 50 else None, i, rng.normal(size=4).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, i int, v array<double>")
    want, last = {}, {}
    for g, i, v in rows:
        if g in last:
            want[i] = float(np.dot(last[g], v) / np.linalg.norm(last[g]) / np.linalg.norm(v))
        last[g] = v
    for size in (100, 10_000):
        got = {r.i: r.similarity for r in relational.adjacent_similarity(df, "g", "i", "v", size).collect()}
        assert len(got) == 900 and {i: pytest.approx(s) for i, s in got.items() if s is not None} == want


def test_hot_contents(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i // 6}") for i in range(600)], "i int, c string")
    got = {r.i: (r.file_hash, r.copies) for r in relational.content_hashes(df, "c", 4).collect()}
    assert got == {i: (hashlib.md5(("same" if i % 3 else f"t{i // 6}").encode()).hexdigest(), 400 if i % 3 else 2) for i in range(600)}


def test_timed_cache():
    now = [0.0]
    c = TimedCache(2, 10, lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)  # b was used least recently
    assert (c.get("a"), c.get("b"), c.get("c"), len(c)) == (1, None, 3, 2)
    now[0] = 10.5
    assert c.get("a") is None and len(c) == 0
    asked = []
    model = cached(lambda texts: [asked.append(t) or len(t) for t in texts], TimedCache(3))
    assert model(["a", "bb", "a"]) == [1, 2, 1] and model(["bb", "ccc"]) == [2, 3] and asked == ["a", "bb", "ccc"]
    assert model([str(i) for i in range(9)] * 2) == [1] * 18 and len(asked) == 12


def test_rag_template(spark):
    turns = [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"), ("user", "q3")]
    df = spark.createDataFrame([("S", "hỏi?", "E", turns), ("", "x", None, [])], "s string, q string, c string, h array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(dialogue.render_rag(F.col("s"), F.col("q"), F.col("c"), F.col("h"))).collect()]
    assert got == [
        'S\n\n### Ngữ cảnh trước đó\n- Người hỏi: q3\n- Trả lời: a2\n- Người hỏi: q2\n- Trả lời: a1\n\n### Câu hỏi\n"hỏi?"\n\n### Bằng chứng y khoa\nE',
        '### Câu hỏi\n"x"\n\nKhông có tài liệu liên quan đến câu hỏi này.',
    ]


def test_fusion(spark):
    ranked = spark.createDataFrame([("x", 1), ("y", 2), ("y", 1)], "id string, rank int")
    rows = search.fuse(ranked, "id").collect()
    assert [r.id for r in rows] == ["y", "x"] and rows[0].fused == pytest.approx(1 / 62 + 1 / 61)


def test_paging(spark):
    df = spark.range(11).withColumn("k", F.lit(1)).withColumnRenamed("id", "_id")
    p = paging.paginate(df, page=2, limit=10, sort_by="k", order="asc")
    assert (p.total, p.total_pages, [r._id for r in p.items.collect()]) == (11, 2, [10])
    assert [paging.Page(None, n, 1, 10).total_pages for n in (0, 1, 10, 11)] == [0, 1, 1, 2]
    assert paging.sort_column(df, "nope", ["title"]) == "updated_at"
    for bad in ({"page": 0}, {"limit": 101}, {"order": "up"}):
        with pytest.raises(InvalidArgument):
            paging.page_of(df, **{"sort_by": "k", **bad})


def test_predicates(spark):
    ids = spark.createDataFrame([("0123456789abcdefABCDEF01",), ("xyz",), ("0123456789abcdefABCDEF0",)], "i string")
    assert [r[0] for r in ids.select(predicates.is_object_id(F.col("i"))).collect()] == [True, False, False]
    assert ids.filter(predicates.below("i", 0)).count() == 3 and ids.filter(predicates.matches("i", "  ")).count() == 3
    assert ids.filter(predicates.matches("i", "XYZ")).count() == 1 and ids.filter(predicates.matches("i", "x.z", literal=True)).count() == 0
    with pytest.raises(InvalidArgument):
        predicates.check_settings([], 5, 0.7)
    with pytest.raises(InvalidArgument):
        predicates.check_message(" a ")
    assert len(predicates.check_message("x" * 2000)) == 1000


def test_search_keeps_k_of_each_collection(spark):
    rows = [(f"{c}{i}", c, [float(i), 1.0]) for c in "abc" for i in range(5)]
    points = spark.createDataFrame(rows, "id string, knowledge_id string, embedding array<float>")
    hits = search.retrieve(points, [1.0, 0.0], 2, 0.0).collect()
    assert len(hits) == 6 and {h.id[1] for h in hits} == {"3", "4"} and [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    assert search.search(points, [1.0, 0.0], 2, 0.99, ["a", "zz"]).count() == 0
    assert search.relevant(points.limit(5), [0.0, 1.0], threshold=1.0).count() == 1
    with pytest.raises(InvalidArgument):
        search.retrieve(points, [])


def test_limit_before_filter_is_kept(spark):
    df = spark.createDataFrame([(1, "u", "low"), (2, "u", "low"), (3, "u", "high")], "t int, u string, s string")
    assert relational.last_n(df, ["u"], [F.asc("t")], 2).filter("s = 'high'").count() == 0


def test_chunks():
    pack = Packer(max_tokens=30, min_tokens=12, overlap_tokens=8)
    text = "[HEADING]Mở đầu[/HEADING] " + " ".join(f"câu số {i} có sáu từ đây." for i in range(3)) + " [PAGE_BREAK] " + " ".join(f"đoạn hai {i} cũng có bảy từ." for i in range(3)) + "[PAGE_BREAK] tail."
    chunks = pack(text)
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and chunks[0]["section"] == "Mở đầu" and not any("tail" in c["content"] for c in chunks)
    assert structure("a[PAGE_BREAK]b")[1] == ("page_break", "")
    near = Packer(encode=lambda s: [[1, 0], [1, 0], [0, 1]], threshold=0.5)
    assert near.segments(["a b", "c d", "e f"]) == ["a b c d", "e f"]
    same = Packer(encode=lambda s: [[1, 0], [1, 1]], threshold=0.5**0.5 - 1e-12)
    assert same.segments(["a", "b"]) == ["a b"]


def test_registered_sql_and_models(spark):
    register_sql(spark)
    row = spark.sql("select clean_text('a [ 3 ] b') c, is_noisy('a b') n, split_sentences('Một hai. Ba bốn!') s, cosine_similarity(array(1D, 0D), array(1D, 1D)) k").first()
    assert (row.c, row.n, row.s) == ("a b", True, ["Một hai.", "Ba bốn!"]) and row.k == pytest.approx(0.5**0.5)
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(embedder(size=8)(F.col("t"))).collect()] == [8, 8]
    assert df.select(generator(lambda: (lambda p: p.upper()), "sorry")(F.col("t"))).collect()[0][0] == "A B"
    assert df.select(generator(None, "sorry")(F.col("t"))).first()[0] == "sorry"


def test_tables_as_markdown(spark):
    """Tables and rows without cells, null rows and cells."""
    cases = [([], ""), (None, ""), ([[]], ""), ([None, ["a"]], ""), ([[], ["a"]], ""), ([["a"]], "| a |\n| --- |"), ([["a", "b"], [], None, ["c"]], "| a | b |\n| --- | --- |\n| c |"), ([["a"], [None]], "[BẢNG]"), ([[None]], "[BẢNG]"), ([[""]], "|  |\n| --- |")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t array<array<string>>")
    assert [r.m for r in df.select("i", T.table_markdown(F.col("t")).alias("m")).orderBy("i").collect()] == [want for _, want in cases]


def test_the_model_is_called_for_many_texts_at_once():
    """Chunks are those of each text by itself, with a call for SENTENCES of them."""
    from tarnlake.functions.registry import sentence_encoder
    from tarnlake.operators import chunking

    calls = []

    def encode(sentences, own=sentence_encoder(64)):
        calls.append(len(sentences))
        return own(sentences)

    texts = [". ".join(f"word{(i * j) % 7} of sentence {j % 5} again" for j in range(i % 40)) + ". [PAGE_BREAK] [HEADING]h[/HEADING] One more here. And its like here." * (i % 3) for i in range(300)]
    pack = chunking.Packer(max_tokens=40, min_tokens=5, overlap_tokens=9, threshold=0.5, encode=encode)
    want = [pack(t) for t in texts]
    alone, calls[:] = len(calls), []
    assert list(pack.all(texts)) == want and any(len(c) > 2 for c in want)
    assert len(calls) <= 2 + sum(calls) // chunking.SENTENCES and alone > 200


def test_sections_and_statistics_in_place(spark):
    """Against a loop over lines, and against windows over a table of chunks; with no shuffle in the plan."""
    import random

    from tarnlake.operators.chunking import chunk_stats, chunk_stats_of

    rng = random.Random(2)
    rows = [(i, [rng.choice(["# a", "# b", "x", "y", ""]) for _ in range(rng.randrange(12))]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, lines array<string>")
    out = df.select("id", T.sections(F.col("lines"), lambda x: x.startswith("#")).alias("s"))
    for r in out.collect():
        own, section, want = dict(rows)[r.id], None, []
        for x in own or []:
            section = x if x.startswith("#") else section
            want.append((section, x))
        assert [(s.section, x) for s in r.s or [] for x in s.lines] == want
        assert [x for s in r.s or [] for x in own[s.first : s.first + len(s.lines)]] == (own or [])
    chunks = df.select("id", F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("content"))).alias("c"))
    got = chunk_stats_of(chunks, "c")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    table_ = df.select("id", F.posexplode("lines").alias("pos", "content"))
    key = lambda d: sorted(tuple(r) for r in d.select("id", "pos", "chunk_index", "chunk_count", "word_count").collect())
    assert key(got) == key(chunk_stats(table_, "id", "pos", "content"))


def test_trend_template(spark):
    """The greeting by age and the first time, notes that are left out if there are none, nulls."""
    rows = [("An", 65, True, "n"), ("Bình", 49, True, None), ("An", 50, False, ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, age int, first boolean, notes string")
    got = [r.p for r in df.select(dialogue.render_trend(F.lit("s"), F.lit("q?"), F.col("name"), F.col("age"), F.lit("p"), F.lit("d"), F.col("notes"), F.col("first"), "g").alias("p")).collect()]
    rest = lambda who, notes="": f"### Thông tin bệnh nhân\np\n\n### Dữ liệu sức khỏe\nd\n\n{notes}### Câu hỏi của {who}\n\"q?\"\n\ng"
    assert got == ["s\n\nChào bác An,\n\n" + rest("bác", "### Ghi chú theo dõi\nn\n\n"), "s\n\nChào anh/chị Bình,\n\n" + rest("anh/chị"), "s\n\nDạ, theo dõi gần đây,\n\n" + rest("bác"), "s\n\nDạ, theo dõi gần đây,\n\n" + rest("anh/chị")]


def test_sentences_keep_their_digits(spark):
    """A sentence's number in its text has no part in what is trimmed."""
    text = "0 first one 0. 148.9.179.11 is second 1! 2 more 22. 33 33 3? 4 last 44"
    assert value(spark, text, T.sentences) == ["0 first one 0.", "148.9.179.11 is second 1!", "2 more 22.", "33 33 3?", "4 last 44"]


def test_a_batch_is_read_in_pieces_of_bounded_size():
    """An Arrow batch's texts become Python's a bounded number of bytes at a time, none lost; only a longer text is alone."""
    import pyarrow as pa

    from tarnlake.functions.registry import pieces

    texts = ["é" * 30, None, "", "x" * 500, *["y" * 40] * 50]
    got = list(pieces(pa.array(["skipped", *texts]).slice(1), 100))
    assert [t for p in got for t in p] == [t or "" for t in texts] and all(len(p) == 1 or sum(len(t.encode()) for t in p) <= 100 for p in got)
    assert list(pieces(pa.array([], pa.string()))) == [] and max(map(len, pieces(pa.array([""] * 2500)))) == 1000


def test_a_long_text_goes_to_the_model_in_parts(monkeypatch):
    """No call has more than SENTENCES, and borders between calls are judged as others."""
    from tarnlake.functions.registry import sentence_encoder
    from tarnlake.operators import chunking

    calls = []

    def encode(sentences, own=sentence_encoder(64)):
        calls.append(len(sentences))
        return own(sentences)

    text = ". ".join(f"word{j % 7} of sentence {j % 5} again and again" for j in range(200)) + "."
    pack = lambda: chunking.Packer(max_tokens=40, min_tokens=5, overlap_tokens=9, threshold=0.9, encode=encode)(text)
    want = pack()
    monkeypatch.setattr(chunking, "SENTENCES", 16)
    calls.clear()
    assert pack() == want and len(want) > 20 and max(calls) <= 16

"""Queries that once gave less than the whole job, against brute force."""

import hashlib
import re
import sys
from types import ModuleType, SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.functions.registry import hash_vector, sentence_encoder
from tarnlake.functions.text import MEDICAL_TERMS, is_noise_block, is_pdf_heading, is_valid_heading
from tarnlake.operators import relational
from tarnlake.operators.chunking import Packer, chunk_documents
from tarnlake.plans import dialogues, texts
from tarnlake.plans.ingestion import ingest
from tarnlake.session import table
from tarnlake.sources.files import objects, parse_pdf, pdf_lines


def cut_sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?…])\s+", " ".join(text.split())) if len(s.strip()) > 3]


def plain_chunks(text, most=512, least=50, lap=64, threshold=0.7):
    """The service's rules, a sentence at a time; the text has no marks."""
    sentences = cut_sentences(text)
    vectors = [np.array(hash_vector(s, 768), float) for s in sentences]
    segments = []
    for i, s in enumerate(sentences):
        if i and vectors[i - 1] @ vectors[i] >= threshold * np.linalg.norm(vectors[i - 1]) * np.linalg.norm(vectors[i]):
            segments[-1] += " " + s
        else:
            segments.append(s)
    out, held, n = [], "", 0

    def close():
        words = len(held.split())
        if not (words < 10 or held.count("|") / (words + 1) > 0.3 or ("Wikipedia" in held and "://" not in held)):
            out.append(held.strip())

    for s in segments:
        m = len(s.split())
        tail = " ".join(held.split(" ")[-5:]).lower().strip()
        glued = held and m < 50 and any(tail.endswith(t[:i].strip()) and s.lower().strip().startswith(t[i:].strip()) for t in MEDICAL_TERMS for i in range(3, len(t) - 2))
        if not glued and n + m > most and n >= least:
            close()
            again = []
            for last in reversed(cut_sentences(held)[-2:]):
                if len(" ".join([last, *again]).split()) > lap:
                    break
                again.insert(0, last)
            held = " ".join([*again, s])
            n = len(held.split())
        else:
            held, n = (held + " " + s if held else s), n + m
    if held and n >= least:
        close()
    return out


def test_sentence_encoder():
    given = ["a b a", "", "Đường huyết cao.", "a b a"]
    assert np.array_equal(sentence_encoder(8)(given), np.array([hash_vector(t, 8) for t in given], np.float32))
    assert sentence_encoder(8)([""]).shape == (1, 8)


def test_semantic_chunks(spark, sf_small):
    docs = {r.doc_id: r.text for r in table(spark, sf_small, "documents").select("doc_id", "text").collect()}
    got = {}
    for r in texts.semantic_chunks(spark, sf_small).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.word_count, r.content_md5))
    want = {k: [(len(c.split()), hashlib.md5(c.encode()).hexdigest()) for c in plain_chunks(t)] for k, t in docs.items()}
    assert got == {k: v for k, v in want.items() if v}
    assert max(map(len, got.values())) > 1


def test_chunks_of_a_fixture(spark):
    alike = " ".join(["một hai ba bốn năm sáu bảy tám chín mười."] * 60)
    other = " ".join(f"câu số {i} có vài từ khác hẳn x{i} y{i} z{i}." for i in range(70))
    glued = " ".join(f"t{i} u{i} v{i} w{i} đường. Huyết của người bệnh p{i} q{i}." for i in range(60))
    given = [("alike", alike), ("other", other), ("glued", glued), ("both", alike + " " + other), ("empty", ""), ("none", None)]
    df = spark.createDataFrame(given, "doc_id string, text string")
    got = {r.doc_id: list(r.c) for r in chunk_documents(df, load=sentence_encoder, min_tokens=50, threshold=0.7).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c")).collect()}
    assert {k: [c.content for c in v] for k, v in got.items()} == {k: c for k, t in given if (c := plain_chunks(t or ""))}
    assert len(got["alike"]) == 1 and len(got["other"]) == 2


def plain_guard(text):
    """The output guard, a line at a time."""
    if not text.strip(" "):
        return T.GUARD_EMPTY
    if any(w in text.lower() for w in T.CODE_WORDS):
        return T.GUARD_CODE
    thinking, lines = False, []
    for line in text.split("\n"):
        if any(w in line.lower() for w in T.THINKING):
            thinking = True
        elif line.startswith("### "):
            thinking = False
        if not thinking and line.strip(" "):
            lines.append(line)
    out = "\n".join(lines).strip(" ")
    return T.GUARD_ENGLISH if out.startswith(tuple(T.ENGLISH_STARTS)) else out or T.GUARD_NOTHING


def test_answer_guard_on_the_whole_table(spark, sf_small):
    rows = table(spark, sf_small, "conversations").filter("role = 'assistant'").collect()
    want = {(r.conv_id, r.turn): hashlib.md5(plain_guard(r.text).encode()).hexdigest() for r in rows}
    assert {(r.conv_id, r.turn): r.answer_md5 for r in texts.answer_guard(spark, sf_small).collect()} == want
    odd = ["", "  ", "import x", "I am", "phân tích\nx\n### y\n\nz", "a\nlet me think\nb", "You\n", "step by step"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r[0] for r in df.select(T.guard_answer(F.col("t"))).collect()] == [plain_guard(t) for t in odd]


def test_ingest_breaks_at_differences(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" ".join(f"Câu số {i} nói về chuyện khác x{i} y{i} z{i}." for i in range(120)))
    assert ingest(objects(spark, f"file://{tmp_path}"), spark.createDataFrame([], "file_hash string"), "k")["document_chunks"].count() > 1


def sessions(spark, sf):
    found = {}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        found.setdefault(r.conv_id, []).append(r)
    return found


def test_messages_of_all_sessions(spark, sf_small):
    got = {r.conv_id: (r.messages, r.last_turn) for r in dialogues.session_messages(spark, sf_small).collect()}
    assert got == {k: (len(v), v[-1].turn) for k, v in sessions(spark, sf_small).items()}


def test_history_lines_are_whole(spark, sf_small):
    got = {r.conv_id: r.lines for r in dialogues.history_lines(spark, sf_small).collect()}
    assert got == {k: "\n".join(f"{r.role.capitalize()}: {r.text}" for r in v) for k, v in sessions(spark, sf_small).items()}


def test_history_with_the_services_limits(spark, sf_small):
    every = sorted((k, r.turn) for k, v in sessions(spark, sf_small).items() for r in v)
    assert max(len(v) for v in sessions(spark, sf_small).values()) <= 10
    for query in (dialogues.history_oldest20, dialogues.history_last10):
        assert sorted((r.conv_id, r.turn) for r in query(spark, sf_small).collect()) == every


def test_history_limits(spark):
    m = spark.createDataFrame([("s", i, "user") for i in range(25)] + [("t", 7, "assistant")], "session string, turn int, role string")
    oldest = sorted((r.session, r.turn, r.rn) for r in relational.session_history(m, "session", "turn").collect())
    assert oldest == [("s", i, i + 1) for i in range(20)] + [("t", 7, 1)]
    newest = sorted((r.session, r.turn, r.nth) for r in relational.recent_history(m, "session", "turn").collect())
    assert newest == [("s", i, i - 14) for i in range(15, 25)] + [("t", 7, 1)]
    assert sorted(r.turn for r in relational.recent_history(m, "session", "turn", 3).filter("session = 's'").collect()) == [22, 23, 24]


ELEMENTS = [
    ("  Chế độ ăn\n", [16.0, 15.0], ["Arial"]), ("Nội dung thường của phần này.", [11.0], ["Arial"]), ("Mới chọn: bài viết", [20.0], ["Arial"]),
    ("Vận động", [11.0], ["Arial-Bold"]), ("Bệnh này được mô tả", [18.0], ["Arial"]), ("Có dấu chấm.", [18.0], ["Arial"]), ("a, b, c", [18.0], []),
    ("x" * 101, [18.0], []), ("đúng mười bốn", [14.0], []), ("không cỡ chữ", [], ["Bold"]), ("[xin\nĐỌC TIẾP đi]", [9.0], []), ("  ", [20.0], []),
]


def test_pdf_rules(spark):
    got = pdf_lines(ELEMENTS)
    assert got[0] == "[HEADING]Chế độ ăn[/HEADING]" and got[2] == "[HEADING]Vận động[/HEADING]" and len(got) == 9
    df = spark.createDataFrame([(i, t.strip(), s, f) for i, (t, s, f) in enumerate(ELEMENTS) if t.strip()], "i int, t string, s array<double>, f array<string>")
    flat = F.regexp_replace("t", r"\s+", " ")
    rows = df.select("i", "t", is_noise_block(flat).alias("noise"), (is_pdf_heading(F.col("s"), F.col("f")) & is_valid_heading(F.col("t"))).alias("head")).orderBy("i").collect()
    assert got == [f"[HEADING]{r.t}[/HEADING]" if r["head"] else r.t for r in rows if not r.noise]


def test_pdf_has_headings_and_no_furniture(monkeypatch):
    """On stand-ins for the library's modules."""

    class Char(SimpleNamespace):
        pass

    class Box(list):
        def get_text(self):
            return self.text

    def box(text, sizes, fonts):
        b = Box([[Char(size=s, fontname=(fonts or [""])[0]) for s in sizes]])
        b.text = text
        return b

    page = SimpleNamespace(extract_tables=lambda: [[["a", None]]], extract_text=lambda: "plain")

    class Pdf:
        pages = [page]
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    fakes = {n: ModuleType(n) for n in ("pdfplumber", "pdfminer", "pdfminer.high_level", "pdfminer.layout")}
    fakes["pdfplumber"].open = lambda f: Pdf()
    fakes["pdfminer.high_level"].extract_pages = lambda f, laparams: [[box(*e) for e in ELEMENTS] + ["a figure"]]
    vars(fakes["pdfminer.layout"]).update(LAParams=lambda **_: None, LTChar=Char, LTTextContainer=Box)
    for n, m in fakes.items():
        monkeypatch.setitem(sys.modules, n, m)
    text, tables = parse_pdf(b"", "a.pdf")
    assert tables == [[["a", ""]]] and text.split("\n")[:3] == ["[TABLE]", "[HEADING]Chế độ ăn[/HEADING]", "Nội dung thường của phần này."]
    assert "Mới chọn" not in text and "ĐỌC TIẾP" not in text
    assert Packer(min_tokens=1)(text)[0]["section"] == "Vận động"


def test_phrase_cut_at_every_border(spark, sf_small):
    given = [(1, "Chỉ một câu."), (2, "A b the end. And more here. The end. Nothing. The end. " + "x" * 300 + " the end. And more."), (3, "")]
    df = spark.createDataFrame(given, "k int, text string")
    got = sorted((r.k, r.pos, r.cut) for r in texts.sentence_borders(df, ["the end.and more"], "k").collect())
    assert got == [(2, 0, True), (2, 1, False), (2, 2, False), (2, 3, False), (2, 4, False), (2, 5, True)]
    borders = {(k, r.turn): max(len(cut_sentences(r.text)) - 1, 0) for k, v in sessions(spark, sf_small).items() for r in v}
    rows = {(r.conv_id, r.turn): r["count"] for r in texts.phrase_cut_guard(spark, sf_small).groupBy("conv_id", "turn").count().collect()}
    assert rows == {k: n for k, n in borders.items() if n}

"""Sentence ends by a corpus's own abbreviations, against labelled sentences and the plain rule."""

import random
import re

from pyspark.sql import functions as F

from tarnlake.functions.sentences import abbreviations, sentence_spans, spans

#: Labelled sentences: each string is one.
SENTENCES = [
    "BS. Lan khám cho bệnh nhân lúc 8 giờ.", "Kết quả do TS. Minh và ThS. Hà đọc.", "Chỉ số là 7.5 mmol/l sau ăn.", "Ăn nhiều rau, đậu, v.v. mỗi ngày rất tốt.", "Liều dùng khoảng 2.5 mg!", "Có cần tiêm insulin không?",
    "The results, e.g. of Dr. Brown, were clear.", "See fig. 3 and no. 4 for details.", "He takes approx. ten units vs. twelve before.", "J. Smith wrote this in 2. edition form.", "Drink water.", "Walk every day…", "It rose (cf. the table) to 9.",
]


def corpus():
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        own = rng.choices(SENTENCES, k=rng.randrange(2, 9))
        # the words that end sentences stand within others too
        texts.append((own, " ".join(own) + " Drink water before ăn and ngày details clear form before every day tốt giờ đọc mỗi ngày."))
    return texts


def plain(text):
    at, out = 0, []
    for m in re.finditer(r"(?<=[.!?…])\s+", text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def test_better_than_the_rule(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(999, None)], "id int, text string")
    short = abbreviations(df)
    assert {"bs", "ts", "ths", "dr", "fig", "e.g", "vs", "cf", "v.v"} <= set(short) and not {"water", "form", "clear", "details"} & set(short)
    got = {r.id: [(s.start, s.end) for s in r.s] for r in df.filter("text is not null").select("id", sentence_spans(F.col("text"), short).alias("s")).collect()}
    right = {"mine": 0, "rule": 0}
    total = 0
    for i, (own, text) in enumerate(texts):
        want, at = set(), 0
        for s in own:
            want.add((at, at + len(s)))
            at += len(s) + 1
        total += len(want)
        right["mine"] += len(want & set(got[i]))
        right["rule"] += len(want & set(plain(text)))
    assert right["mine"] / total > 0.97 > 0.6 > right["rule"] / total, (right, total)
    assert df.filter("id = 999").select(sentence_spans(F.col("text"), short)).first()[0] is None


def test_offsets_are_of_the_text_as_it_is():
    text = "  Một  câu.\n\nHai câu?!  \t(Ba câu.) 5. lần nữa. A. B đây… "
    assert [text[a:b] for a, b in spans(text, frozenset())] == ["Một  câu.", "Hai câu?!", "(Ba câu.)", "5. lần nữa.", "A. B đây…"]
    assert spans("", frozenset()) == spans(" \n ", frozenset()) == [] and spans("x", frozenset()) == [(0, 1)]
    long = "word. " * 50_000 + "." * 50_000 + "y" * 300_000 + "."
    assert len(spans(long, frozenset(["word"]))) <= 3 and len(spans(long, frozenset())) >= 50_000

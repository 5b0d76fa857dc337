"""Many words at once against an expression for each."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text as T
from tarnlake.functions import words as W
from tarnlake.functions.text import MEDICAL_TERMS
from tarnlake.operators.scoring import LEXICON, NEGATIONS, WEIGHTED, lexicon_hits, relevance


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    parts = [*LEXICON, *NEGATIONS, *MEDICAL_TERMS, "x", "Ở nhà", "İ", "ΟΔΟΣ", "\n", "é" * 40, "the non-insulin and", "not" + "y" * 99, "no" + "y" * 97]
    rows = [" ".join(rng.choice(parts) if rng.random() < 0.8 else rng.choice(parts).upper() for _ in range(rng.randrange(14))) for _ in range(300)]
    rows += [None, "", "insulin", "not insulin", "no" + "z" * 98 + "insulin", "no" + "z" * 99 + "insulin", "insulin not insulin", "glu", "a" * 50_000 + " hba1c"]
    return spark.createDataFrame(list(enumerate(rows)), "id int, t string").cache()


def test_lexicon_and_terms(texts):
    for lexicon, negations in ((WEIGHTED, NEGATIONS), ([("no", 0.5), ("note", 0.25), ("not", 0.1), ("insulin", 0.2), ("not", 0.3)], ["no", "not", "insulin"])):
        got = texts.select(W.lexicon_hits_at_once("t", lexicon, negations).alias("a"), "t").collect()
        for r in got:
            if r.t is not None:
                low = r.t.lower() if "İ" not in r.t and "Σ" not in r.t else None
                if low is not None:
                    want = [w for x, w in lexicon if x in low and not any(n in low[max(0, low.index(x) - 100) : low.index(x)] for n in negations)]
                    assert r.a == want, r.t
    both = texts.select(lexicon_hits(F.col("t")).alias("a"), W.lexicon_hits_at_once(F.col("t")).alias("b"), relevance(F.col("t")).alias("c"), relevance(F.col("t"), hits=W.lexicon_hits_at_once).alias("d"))
    assert both.filter("not (a <=> b) or not (c <=> d)").count() == 0
    assert texts.filter(~T.contains_any(F.col("t"), LEXICON).eqNullSafe(W.contains_any_at_once(F.col("t"), LEXICON))).count() == 0


def test_cut_terms(texts):
    rng = random.Random(3)
    pairs = [(t[:i], t[i:]) for t in MEDICAL_TERMS for i in range(1, len(t))]
    rows = [("so " + a + rng.choice(["", " "]), b + " x") for a, b in pairs] + [(a, rng.choice(pairs)[1]) for a, _ in pairs] + [(None, "a"), ("a", None), ("", "")]
    df = texts.sparkSession.createDataFrame(rows, "a string, b string")
    both = df.select(T.cuts_phrase(F.col("a"), F.col("b")).alias("x"), W.cuts_phrase_at_once(F.col("a"), F.col("b"), MEDICAL_TERMS).alias("y"))
    assert both.filter("coalesce(x, false) <> coalesce(y, false)").count() == 0 and both.filter("y").count() > 50


def test_occurrences_overlap():
    assert list(W.found(("he", "she", "hers", "", "x"), "ushers")) == [(1, 1, 4), (0, 2, 4), (2, 2, 6)]
    assert list(W.found((), "abc")) == list(W.found(("a",), "")) == []


def test_plans_are_as_large_for_many_words(spark, texts):
    """5,000 words have the plan of five, and each is found."""
    words = spark.range(5000).selectExpr("concat('term', id, 'x') as w").union(spark.createDataFrame([("",), (None,)], "w string"))
    many = W.word_table(words, "w")
    assert len(many) == 5000
    with pytest.raises(ValueError):
        W.word_table(words, "w", most=4999)
    few = many[:5]
    size = lambda ws: len(texts.select(W.contains_any_at_once(F.col("t"), ws).alias("x"), W.lexicon_hits_at_once(F.col("t"), [(w, 1.0) for w in ws]).alias("y"), W.cuts_phrase_at_once(F.col("t"), F.col("t"), ws).alias("z"))._jdf.queryExecution().toString())
    assert abs(size(many) - size(few)) < 300
    df = spark.range(0, 5000, 250).selectExpr("concat('a TERM', id, 'x b term7x') as t")
    assert all({many[o.word] for o in r.o} == {f"term{250 * i}x" for i in [r.i]} | {"term7x"} for r in df.select(W.occurrences(F.lower("t"), many).alias("o"), (F.regexp_extract("t", "TERM([0-9]+)", 1).cast("int") / 250).cast("int").alias("i")).collect())
    assert df.filter(W.contains_any_at_once(F.col("t"), many)).count() == 20

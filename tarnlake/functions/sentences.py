"""Where sentences end: full stops after what a corpus itself shows to be abbreviations don't end one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this score on a word is an abbreviation; the share of full stops that abbreviations are taken to have.
LEAST_SCORE, SURE = 0.3, 0.99
WORD = r"\p{L}+(?:\.\p{L}+)*"
_END = re.compile(r"(?<![.!?…])[.!?…]++[\"')\]»”’]*+(?=\s|$)")
_NEXT = re.compile(r"\s*(\S?)")


def dotted_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (lower case, without a full stop at its end), n and dotted (how often, and how often with one), and whole (n of all
    words) and stops (dotted of all), from whole texts. Counts of all words are sums in Spark; a row a word is left."""
    tokens = F.explode(F.split(F.coalesce(text_col, F.lit("")), r"\s+"))
    rows = docs.select(tokens.alias("t")).withColumn("t", F.regexp_replace("t", r"^[(\[{]+", "")).select(F.lower(F.regexp_replace("t", r"\.$", "")).alias("word"), F.col("t").endswith(".").alias("dot")).filter(F.col("word").rlike(f"^{WORD}$"))
    words = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_if("dot").alias("dotted"))
    totals = words.agg(F.sum("n").alias("whole"), F.sum("dotted").alias("stops"))
    return words.join(F.broadcast(totals))  # one row of totals


def scored(words: DataFrame) -> DataFrame:
    """words with score: twice the log-likelihood ratio of full stops after the word as after an abbreviation (SURE), against as after
    any word; less for long words and for each time it stands without one, more for full stops inside."""
    n, k, size = F.col("n"), F.col("dotted"), F.length(F.regexp_replace("word", r"\.", ""))
    log = lambda p: k * F.log(p) + (n - k) * F.log(1 - p)
    any_word = F.least(F.greatest(F.col("stops") / F.col("whole"), F.lit(1e-9)), F.lit(1 - 1e-9))
    inside = F.length("word") - size + 1
    ratio = 2 * (log(F.lit(SURE)) - log(any_word))
    return words.withColumn("score", ratio * F.exp(-size.cast("double")) * inside * F.pow(size.cast("double"), k - n))


def abbreviations(docs: DataFrame, text_col: str = "text", most: int = 100_000) -> list[str]:
    """The words that score LEAST_SCORE or more, the `most` best of them: a bounded list, for `sentence_spans`."""
    found = scored(dotted_words(docs, text_col)).filter((F.col("score") >= LEAST_SCORE) & (F.col("dotted") > 0))
    return sorted(r.word for r in found.orderBy(F.desc("score"), "word").limit(most).select("word").collect())


def spans(text: str, short: frozenset[str]) -> list[tuple[int, int]]:
    """Start and end of each sentence in the text as it is. A full stop ends none after an abbreviation, after a single letter, or
    after a number that goes on in lower case; other signs always end one. Spans have no white space at their ends."""
    out, begin = [], 0
    for m in _END.finditer(text):
        if m[0][0] == "." and not m[0].startswith(".."):
            at = m.start()
            while at > begin and not text[at - 1].isspace() and text[at - 1] not in "([{«“‘\"'":
                at -= 1
            word, after = text[at : m.start()].lower(), _NEXT.match(text, m.end())[1]
            if word in short or (len(word) == 1 and word.isalpha()) or (word[-1:].isdigit() and after.islower()):
                continue
        out.append((begin, m.end()))
        begin = m.end()
    out.append((begin, len(text)))
    trimmed = ((a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in out)
    return [(a, b) for a, b in trimmed if a < b]


def sentence_spans(text: Column, short: list[str]) -> Column:
    """array<struct<start, end>> of a text's sentences, in letters of the whole text; null for a null text."""
    known = frozenset(short)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else [{"start": a, "end": b} for a, b in spans(t, known)] for t in batch], dtype=object)

    return find(text)

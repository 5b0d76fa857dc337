"""Many words looked for at once: one automaton finds all of them in one pass over a text, however many there are.

A plan has one Python step, whatever the number of words; they are shipped with it, or come from a table by `word_table`."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.scoring import NEGATIONS, WEIGHTED

#: Letters before a word in which a negation is looked for.
BEFORE = 100


def word_table(words: DataFrame, column: str, most: int = 1_000_000) -> list[str]:
    """The different words of a table, in order; a table of more than `most` is refused, as an automaton is in every task's memory."""
    rows = words.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    return sorted(r[0] for r in rows)


@functools.lru_cache(maxsize=8)
def automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:
            out.add_word(w, (i, len(w)))
    out.make_automaton()
    return out


def found(words: tuple[str, ...], text: str) -> Iterator[tuple[int, int, int]]:
    """Number of the word, start and end of each occurrence in the text, overlapping ones too, by their ends."""
    machine = automaton(words)
    if len(machine):
        for last, (i, size) in machine.iter(text):
            yield i, last + 1 - size, last + 1


def occurrences(text: Column, words: list[str]) -> Column:
    """array<struct<word, start, end>> of all occurrences of the words (as numbers) in a text as it is, by their ends; null for a null text."""
    words = tuple(words)

    @F.pandas_udf("array<struct<word:int,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else [{"word": i, "start": a, "end": b} for i, a, b in found(words, t)] for t in batch], dtype=object)

    return find(text)


def contains_any_at_once(text: Column, terms: list[str]) -> Column:
    """text.contains_any for any number of terms."""
    terms = tuple(dict.fromkeys(terms))

    @F.pandas_udf("boolean")
    def any_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else "" in terms or next(found(terms, t), None) is not None for t in batch], dtype=object)

    return any_of(F.lower(text))


def weights_of(text: str, entries: tuple[tuple[str, float], ...], negations: tuple[str, ...]) -> list[float]:
    """Weights of the entries, in their order, whose first occurrence has no negation in the BEFORE letters before it."""
    terms, against = {t for t, _ in entries}, {*negations}
    words = _all(entries, negations)
    first: dict[str, int] = {"": 0}
    away: list[tuple[int, int]] = []
    for i, start, end in found(words, text):
        if words[i] in terms:
            first.setdefault(words[i], start)
        if words[i] in against:
            away.append((start, end))
    negated = {t for t, p in first.items() if any(p - BEFORE <= a and b <= p for a, b in away)}
    return [w for t, w in entries if t in first and t not in negated]


@functools.lru_cache(maxsize=8)
def _all(entries: tuple[tuple[str, float], ...], negations: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*(t for t, _ in entries), *negations]))


def lexicon_hits_at_once(text: Column, lexicon: list[tuple[str, float]] = WEIGHTED, negations: list[str] = NEGATIONS) -> Column:
    """scoring.lexicon_hits for a lexicon of any size: words, weights and negations in one pass; a null text has none."""
    entries, negations = tuple((t, float(w)) for t, w in lexicon), tuple(negations)

    @F.pandas_udf("array<double>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[] if t is None else weights_of(t, entries, negations) for t in batch], dtype=object)

    return hits(F.lower(text))


@functools.lru_cache(maxsize=8)
def cuts_of(terms: tuple[str, ...], least: int = 3) -> dict[str, set[str]]:
    """The rest of each term by its beginning, cut `least` or more letters from both ends."""
    out: dict[str, set[str]] = {}
    for t in terms:
        for i in range(least, len(t) - least + 1):
            out.setdefault(t[:i], set()).add(t[i:])
    return out


def cuts_phrase_at_once(before: Column, after: Column, terms: list[str]) -> Column:
    """text.cuts_phrase for any number of terms: the first text's ends of each length are looked up among the terms' beginnings."""
    terms = tuple(terms)

    @F.pandas_udf("boolean")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        heads = cuts_of(terms)
        sizes = sorted({len(h) for h in heads})
        for a, b in batches:
            rows = zip(a, b, strict=True)
            yield pd.Series([None if x is None or y is None else any(y.startswith(rest) for n in sizes if n <= len(x) for rest in heads.get(x[-n:], ())) for x, y in rows], dtype=object)

    return cut(F.lower(before), F.lower(after))

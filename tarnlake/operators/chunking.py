"""Documents into chunks: structure, sentences, similarity breaks, greedy packing with overlap.

Packing is a fold over a document's segments with state, so it is one Python step per document (mapInArrow: no
shuffle, as a document is one row); pack_sentences() has the plain rule as a JVM fold over arrays.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.functions.registry import pieces
from tarnlake.functions.text import MEDICAL_TERMS, SEPARATOR, word_count

#: Sentences that the model gets at once.
SENTENCES = 4096
Encode = Callable[[list[str]], "np.ndarray"]
CHUNK = "struct<content:string,chunk_index:int,word_count:int,section:string,chunking_strategy:string>"


def count_words(text: str) -> int:
    return len(text.split())


def split_sentences(text: str) -> list[str]:
    flat = " ".join(text.split())
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?…])\s+", flat)) if len(s) > 3]


def noisy(text: str) -> bool:
    n = len(text.split())
    return n < 10 or text.count("|") / (n + 1) > 0.3 or ("Wikipedia" in text and "://" not in text)


def structure(text: str) -> list[tuple[str, str]]:
    """(kind, content) of page breaks, headings and paragraphs in order; as functions.text.blocks()."""
    out = []
    for part in map(str.strip, re.split(f"({SEPARATOR})", text)):
        if part == "[PAGE_BREAK]":
            out.append(("page_break", ""))
        elif part.startswith("[HEADING]"):
            out.append(("heading", re.sub(r"\[/?HEADING\]", "", part).strip()))
        elif part:
            out.append(("paragraph", part))
    return out


@functools.cache
def _heads(terms: tuple[str, ...]) -> tuple[str, ...]:
    return tuple({t[:i] for t in terms for i in range(3, len(t) - 2)})


def phrase_cut(before: str, after: str, terms: list[str]) -> bool:
    low, high = before.lower(), after.lower()
    return low.endswith(_heads(tuple(terms))) and any(low.endswith(t[:i]) and high.startswith(t[i:]) for t in terms for i in range(3, len(t) - 2))


class Packer:
    """The chunks of one document. Text is gathered segment by segment; a chunk is closed when the next segment would
    pass max_tokens and it has min_tokens at least, and the next one then starts with up to two of its last sentences.

    These are the service's limits, which a long segment passes. With hard, no chunk has more than max_tokens by `count`: segments that
    are longer are cut between words (a longer word between letters), a chunk is closed whatever it has, and the
    sentences before and phrases that a border would cut give way."""

    def __init__(self, max_tokens: int = 512, min_tokens: int = 100, overlap_tokens: int = 64, threshold: float = 0.6, encode: Encode | None = None, count: Callable[[str], int] = count_words, split: Callable[[str], list[str]] = split_sentences, terms: list[str] = MEDICAL_TERMS, short: int = 50, hard: bool = False):
        self.hard = hard
        self.limits = (max_tokens, min_tokens, overlap_tokens, short)
        self.threshold, self.encode, self.count, self.split, self.terms = threshold, encode, count, split, terms

    def prepared(self, text: str) -> list[tuple[str, str, list[str]]]:
        """The blocks of a text: kind, content and, of paragraphs, their sentences."""
        return [(kind, content, self.split(content) if kind == "paragraph" else []) for kind, content in structure(text)]

    def segments(self, sentences: list[str]) -> list[str]:
        return self.runs([sentences])[0]

    def runs(self, paragraphs: list[list[str]]) -> list[list[str]]:
        """Of each paragraph's sentences, runs joined up to each place where neighbours are less alike than the threshold;
        one run without a model, which is called once for all of them."""
        if self.encode is None:
            return [[" ".join(p)] for p in paragraphs]
        several = [i for i, p in enumerate(paragraphs) if len(p) > 1]
        out = [[" ".join(p)] for p in paragraphs]
        if several:
            apart, at = self.breaks([s for i in several for s in paragraphs[i]]), 0
            for i in several:
                p = paragraphs[i]
                ends = [*(np.flatnonzero(apart[at : at + len(p) - 1]) + 1).tolist(), len(p)]
                out[i] = [" ".join(p[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                at += len(p)
        return out

    def breaks(self, sentences: list[str]) -> np.ndarray:
        """Whether each sentence but the first is less like the one before it than the threshold; SENTENCES go to the model at once,
        and of those before them the last vector alone is kept."""
        out, last = [], None
        for i in range(0, len(sentences), SENTENCES):
            v = np.asarray(self.encode(sentences[i : i + SENTENCES]), float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            if last is not None:
                out.append((v[:1] * last).sum(1) < self.threshold)
            out.append((v[1:] * v[:-1]).sum(1) < self.threshold)
            last = v[-1:].copy()
        return np.concatenate(out)

    def all(self, texts: Iterable[str]) -> Iterator[list[dict]]:
        """The chunks of each text. Sentences of many texts go to the model at once: texts are gathered as long as they have
        SENTENCES of them at most."""
        held: list = []
        count = 0
        for text in texts:
            own = self.prepared(text)
            size = sum(len(s) for _, _, s in own)
            if held and count + size > SENTENCES:
                yield from self._packed(held)
                held, count = [], 0
            held.append(own)
            count += size
        yield from self._packed(held)

    def _packed(self, prepared: list) -> Iterator[list[dict]]:
        runs = iter(self.runs([s for blocks in prepared for _, _, s in blocks if s]))
        for blocks in prepared:
            yield self.fold([(kind, content, next(runs) if s else []) for kind, content, s in blocks])

    def within(self, segment: str) -> list[str]:
        """The segment in parts of max_tokens at most, as long as they can be."""
        out, rest, glue = [], segment.split(), " "
        if self.count(segment) <= self.limits[0]:
            return [segment]
        while rest:
            low, high = 0, len(rest)  # `low` of them fit
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.count(glue.join(rest[:mid])) <= self.limits[0] else (low, mid - 1)
            if low:
                out.append(glue.join(rest[:low]))
                rest = rest[low:]
            elif len(rest[0]) == 1:
                raise ValueError("max_tokens is less than a letter has")
            else:  # a word that is too long by itself
                size = len(rest[0])
                while size > 1 and self.count(rest[0][:size]) > self.limits[0]:
                    size = (size + 1) // 2
                rest = [rest[0][:size], rest[0][size:], *rest[1:]]
        return out

    def overlap(self, text: str) -> str:
        taken, used = [], 0
        for s in reversed(self.split(text)[-2:]):
            n = self.count(s)
            if used + n > self.limits[2]:
                break
            taken.insert(0, s)
            used += n
        return " ".join(taken)

    def __call__(self, text: str) -> list[dict]:
        return next(self.all([text]))

    def fold(self, blocks: list[tuple[str, str, list[str]]]) -> list[dict]:
        """Chunks of the blocks (kind, content, segments) in order."""
        most, least, _, short = self.limits
        chunks: list[dict] = []
        held, tokens, section = "", 0, "Unknown"

        def close():
            content = held.strip()
            if not noisy(content):
                chunks.append({"content": content, "chunk_index": len(chunks), "word_count": len(held.split()), "section": section, "chunking_strategy": "semantic_chunk"})

        for kind, content, segments in blocks:
            if kind == "heading":
                section = content
            elif kind == "page_break":
                if held and tokens >= least:
                    close()
                    held, tokens = "", 0
            else:
                for segment in segments if not self.hard else (part for s in segments for part in self.within(s)):
                    n = self.count(segment)
                    full = self.hard and held and self.count(f"{held} {segment}") > most
                    glue = held and n < short and not full and phrase_cut(" ".join(held.rsplit(" ", 5)[-5:]), segment, self.terms)
                    if full or (not self.hard and not glue and tokens + n > most and tokens >= least):
                        close()
                        before = self.overlap(held)
                        held = f"{before} {segment}" if before and not (self.hard and self.count(f"{before} {segment}") > most) else segment
                        tokens = self.count(held)
                    else:
                        held = f"{held} {segment}" if held else segment
                        tokens += n
        if held and tokens >= least:
            close()
        return chunks


def chunk_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", load: Callable[[], Encode] | None = None, **options) -> DataFrame:
    """One row per chunk: id_col, content, chunk_index, word_count, section, chunking_strategy. load() gives the sentence
    encoder, once a task; without it there are no similarity breaks."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        pack = Packer(encode=load() if load else None, **options)
        for batch in batches:
            kind = pa.list_(pa.struct([("content", pa.string()), ("chunk_index", pa.int32()), ("word_count", pa.int32()), ("section", pa.string()), ("chunking_strategy", pa.string())]))
            at = 0
            for texts in pieces(batch.column(1)):  # each handed on before the next is read
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(list(pack.all(texts)), kind)], [id_col, "chunks"])
                at += len(texts)

    packed = d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, chunks array<{CHUNK}>")
    return packed.select(id_col, F.inline("chunks"))


def pack_sentences(sentences: Column, most: int, least: int) -> Column:
    """Greedy packing without overlap as a fold in the JVM: array of (words, sentences) of each group, in order; a group
    is closed when the next sentence would pass `most` words and it has `least`; a last group under `least` is dropped."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    sized = F.transform(sentences, words)
    group = "struct<words:int,sentences:int>"
    start = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.lit(0).alias("words"), F.lit(0).alias("sentences"))

    def step(a, n):
        full = (a["words"] + n > most) & (a["words"] >= least)
        done = F.when(full, F.concat(a["done"], F.array(F.struct(a["words"].alias("words"), a["sentences"].alias("sentences"))))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(full, n).otherwise(a["words"] + n).alias("words"), F.when(full, 1).otherwise(a["sentences"] + 1).alias("sentences"))

    def finish(a):
        return F.when((a["sentences"] > 0) & (a["words"] >= least), F.concat(a["done"], F.array(F.struct(a["words"].alias("words"), a["sentences"].alias("sentences"))))).otherwise(a["done"])

    return F.aggregate(sized, start, step, finish)


def semantic_breaks(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rows of adjacent_similarity() at which a new segment starts: strictly below the threshold."""
    return df.filter(F.col("similarity") < threshold)


def chunk_stats(chunks: DataFrame, by: str, position: str, content: str) -> DataFrame:
    """chunks with word_count, chunk_index (from 0, by position) and chunk_count of each document."""
    w = Window.partitionBy(by)
    index = F.row_number().over(w.orderBy(position)) - 1
    return chunks.withColumns({"word_count": word_count(F.col(content)), "chunk_index": index, "chunk_count": F.count("*").over(w).cast("int")})


def chunk_stats_of(df: DataFrame, chunks: str) -> DataFrame:
    """chunk_stats of chunks that stand in an array of each row (position and content, in order), one row each: nothing is shuffled."""
    rows = df.select(*[c for c in df.columns if c != chunks], F.size(chunks).alias("chunk_count"), F.posexplode(chunks).alias("chunk_index", "_c"))
    return rows.select(*[c for c in df.columns if c != chunks], "_c.*", "chunk_index", "chunk_count").withColumn("word_count", word_count(F.col("content")))

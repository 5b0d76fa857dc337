"""Regex search by an index of trigrams: a pattern's required trigrams select candidates, the pattern itself verifies them."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tarnlake.operators.predicates import matches

#: Alternatives of a pattern that are told apart, and trigrams of each that are looked up, the rarest.
MOST_ALTERNATIVES, MOST_GRAMS = 64, 6
#: Bytes of texts whose trigrams are gathered before they are handed on.
CHUNK_BYTES = 4 << 20


class _Fold(dict):
    """Letters that a pattern without regard to case takes for each other get one form: that of the lower case of the upper."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        upper = c.upper() if len(c.upper()) == 1 else c
        lower = "i" if upper == "\u0130" else upper.lower()
        self[code] = out = lower if len(lower) == 1 else upper
        return out


_FOLD = _Fold()


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


def grams(text: str) -> set[str]:
    return set(map("".join, zip(text, text[1:], text[2:], strict=False)))


def grams_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The trigrams of the lowered texts, in order, and of each the texts that have it: where they begin in a list of texts' numbers
    (and where the last ends), and that list. All letters are taken at once, as numbers."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(codes) < 3:
        return [], np.zeros(1, np.int32), np.empty(0, np.int64)
    known = np.flatnonzero(np.bincount(codes))
    forms, rank = np.unique([ord(_FOLD[c]) for c in known.tolist()], return_inverse=True)
    place = np.zeros(known[-1] + 1, np.int64)
    place[known] = rank
    low, at = place[codes], np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    whole = at[2:] == at[:-2]
    key, at = ((low[:-2] * len(forms) + low[1:-1]) * len(forms) + low[2:])[whole], at[2:][whole]
    if len(forms) ** 3 * len(texts) < 1 << 62:
        pairs = np.sort(key * len(texts) + at)
        key, at = np.divmod(pairs, len(texts))
    else:
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])][: len(key)]
    key, at = key[new], at[new]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    letters = forms[np.stack([key[starts] // len(forms) ** 2, key[starts] // len(forms) % len(forms), key[starts] % len(forms)], axis=1)]
    text = letters.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)], np.r_[starts, len(key)].astype(np.int32), at


def alternatives(pattern: str) -> list[set[str]] | None:
    """Sets of trigrams of which any match has one set whole, or None if a match may have none.

    What is read from the pattern is its runs of plain letters: in sequence, in groups, in alternatives, and in what is
    repeated once at least. Everything else ends a run. A form that can't be read asks for a full scan."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    if tree.state.flags & re.VERBOSE:
        return None
    found = _runs(tree)
    if found is None:
        return None
    sets = [set().union(*map(grams, map(lowered, runs))) for runs in found]
    return sets if all(sets) else None


def _runs(tree) -> list[list[str]] | None:
    """Each alternative of a pattern as its required runs of letters; None if there are too many alternatives."""
    out: list[list[str]] = [[""]]  # the last run of each is still open
    for op, value in tree:
        name, inner = str(op), None
        if name == "LITERAL":
            for runs in out:
                runs[-1] += chr(value)
            continue
        if name == "SUBPATTERN":
            inner = _runs(value[3]) if not (value[1] or value[2]) else [[]]
        elif name == "BRANCH":
            each = [_runs(v) for v in value[1]]
            inner = None if None in each else [r for alternative in each for r in alternative]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner = _runs(value[2]) if value[0] else [[]]
        else:
            inner = [[]]
        if inner is None or len(out) * len(inner) > MOST_ALTERNATIVES:
            return None
        out = [[*a, *b, ""] for a, b in product(out, inner)]
    return out


def index(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The posting table, written to path: gram and the ids of a chunk of texts that have it, sorted by gram over ranges, so that a
    lookup reads the row groups of its grams alone. Rows without an id can't be posted: `search` reads them all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    schema = StructType([StructField("gram", StringType()), StructField("ids", ArrayType(rows.schema["id"].dataType))])
    target = to_arrow_schema(schema)

    def run(batches):
        ids: list[pa.Array] = []
        texts: list[str] = []
        size = 0

        def batch_of():
            found, offsets, at = grams_of(texts)
            own = pa.concat_arrays(ids).take(pa.array(at)) if ids else pa.array([], target.field(1).type.value_type)
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), own).cast(target.field(1).type)], schema=target)
            ids.clear()
            texts.clear()
            return out

        for batch in batches:
            begin = 0
            for i, length in enumerate(pc.binary_length(batch.column(1)).to_pylist(), 1):
                size += length
                if size > CHUNK_BYTES or i == batch.num_rows:
                    ids.append(batch.column(0).slice(begin, i - begin))
                    texts.extend(batch.column(1).slice(begin, i - begin).to_pylist())
                    begin = i
                if size > CHUNK_BYTES:
                    yield batch_of()
                    size = 0
        yield batch_of()

    posted = rows.mapInArrow(run, schema).withColumn("first", F.get("ids", 0))
    posted.repartitionByRange("gram", "first").sortWithinPartitions("gram", "first").drop("first").write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def candidates(posted: DataFrame, pattern: str) -> DataFrame | None:
    """The ids (id) of all texts that may match, or None where the pattern needs no trigram.

    Of each alternative the rarest trigrams are looked up (a row of counts each goes to the driver); leaving others out
    lets more texts through, never fewer."""
    sets = alternatives(pattern)
    if sets is None:
        return None
    asked = sorted(set().union(*sets))
    counts = dict.fromkeys(asked, 0) | {r.gram: r.n for r in posted.filter(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}
    chosen = [sorted(s, key=lambda g: (counts[g], g))[:MOST_GRAMS] for s in sets]
    chosen = [s for s in chosen if all(counts[g] for g in s)]  # a trigram that no text has: no match by this alternative
    every = sorted({g for s in chosen for g in s})
    of = F.array_sort(F.collect_set("gram"))
    has = posted.filter(F.col("gram").isin(every)).select("gram", F.explode("ids").alias("id")).groupBy("id").agg(of.alias("grams"))
    fits = F.lit(False)
    for s in chosen:
        fits = fits | (F.size(F.array_intersect("grams", F.array(*map(F.lit, s)))) == len(s))
    return has.filter(fits).select("id")


def search(docs: DataFrame, posted: DataFrame, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose text matches, as predicates.matches tells it (without regard to case): candidates first, then the pattern."""
    ids = candidates(posted, pattern)
    if ids is not None:
        nowhere = docs.filter(F.col(id_col).isNull())
        docs = docs.join(ids.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left_semi").unionByName(nowhere)
    return docs.filter(matches(text_col, pattern))

"""Quality by positive-unlabelled learning: the non-negative unbiased risk of trusted positives and all unlabelled text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from tarnlake.llm.common import arrow_schema, documents, slices, stored

#: Signs other than those of ordinary prose.
_ODD = re.compile(r"[^\w\s.,;:?!'\"()\-]")
_SHARES = [0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8]
#: Each measure with the upper ends of its bins, which are the same for any corpus; a last bin is above them.
MEASURES = {
    "odd_chars": _SHARES, "odd_words": _SHARES, "mark_chars": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2], "digit_chars": _SHARES, "upper_chars": _SHARES, "capital_words": _SHARES,
    "same_next": _SHARES, "same_after_next": _SHARES, "top_word": [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5], "distinct_words": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "repeated_lines": _SHARES, "repeated_runs": _SHARES, "mean_word": [2, 3, 4, 5, 6, 7, 8, 10, 15, 30], "longest_word": [8, 12, 16, 20, 25, 40, 80, 200], "words": [0, 2, 5, 10, 20, 40, 80, 160, 400, 1000, 3000, 10000],
    "line_words": [1, 2, 4, 8, 16, 32, 64, 128], "loud_words": _SHARES, "long_words": _SHARES, "wordless": _SHARES, "space_chars": [0.05, 0.1, 0.12, 0.15, 0.18, 0.22, 0.3, 0.5],
}
_EDGES = {name: np.array(edges, float) for name, edges in MEASURES.items()}
_BASE = np.cumsum([1, *(len(e) + 1 for e in MEASURES.values())])
COUNTS = ("n", "good", "first")
#: Features: one that is always on, and one per bin.
FEATURES = int(_BASE[-1])


def measures(text: str) -> list[float]:
    """MEASURES of a whole text, in their order; shares of nothing are zero."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(MEASURES)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    runs = max(0, n - 4)
    again = runs - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))
    lengths = [*map(len, words)]
    letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    odd = _ODD.findall(text)
    odd_words = sum(1 for w in words if _ODD.search(w)) if odd else 0
    return [
        len(odd) / chars, odd_words / n, len(re.findall("[.,;:?!]", text)) / chars, len(re.findall("[0-9]", text)) / chars, upper / max(1, letters), sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, sum(map(str.__eq__, words, words[2:])) / n, max(counts.values()) / n if n > 20 else 0.0, len(counts) / n,
        1 - len(set(lines)) / len(lines), again / n, sum(lengths) / n, max(lengths), n,
        n / len(lines), sum(1 for w in words if w[-1] == "!") / n, sum(1 for k in lengths if k > 20) / n, sum(1 for w in words if not re.search(r"\w", w)) / n, (chars - sum(lengths)) / chars,
    ]


def codes(text: str) -> bytes:
    """The bin of each measure."""
    return bytes(int(np.searchsorted(e, x)) for e, x in zip(_EDGES.values(), measures(text), strict=True))


@dataclass
class Model:
    """weights: of each feature; a text's value is their sum, from -1 to 1 if it could be told for sure, and its score (1 + value) / 2.
    prior: the estimated share of good texts. Without trusted positives nothing can be told apart, and all have a score of 1."""

    weights: np.ndarray = field(default_factory=lambda: np.eye(1, FEATURES)[0])
    prior: float = 1.0


def places(coded: pa.Array) -> np.ndarray:
    """Numbers of the features that are on, but the first: a row per text."""
    return np.frombuffer(b"".join(coded.to_pylist()), np.uint8).reshape(-1, len(MEASURES)) + _BASE[:-1]


def values(weights: np.ndarray, coded: pa.Array) -> np.ndarray:
    return weights[0] + weights[places(coded)].sum(axis=1)


def coded(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, codes and a hash of each row's whole text; the only pass over texts."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    schema = StructType([d.schema["doc_id"], d.schema["key"], StructField("codes", BinaryType())])

    def run(batches):
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([codes(t) for t in batch.column(1).to_pylist()], pa.binary())], schema=arrow_schema(schema))

    return stored(d.mapInArrow(run, schema), "quality-codes")


def moments(texts: DataFrame) -> list[np.ndarray]:
    """For all texts, trusted ones, and those of the first half of them (codes, trusted, half), how many have each pair of
    features: sums over the whole corpus, of which the driver gets FEATURES^2 at most."""

    def count(batches):
        total = np.zeros((3, FEATURES, FEATURES), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                on = np.zeros((part.num_rows, FEATURES), np.float32)
                on[:, 0] = 1
                np.put_along_axis(on, places(part.column(0)), 1, axis=1)
                good, half = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                for k, own in enumerate((slice(None), good, good & half)):
                    total[k] += (on[own].T @ on[own]).astype(np.int64)
        i, j = np.nonzero(np.triu(total[0]))
        yield pa.RecordBatch.from_arrays([pa.array(i * FEATURES + j), *(pa.array(t[i, j]) for t in total)], ["cell", *COUNTS])

    rows = texts.select("codes", "trusted", "half").mapInArrow(count, "cell long, n long, good long, first long")
    sums = rows.groupBy("cell").agg(*[F.sum(c).alias(c) for c in COUNTS]).toArrow()
    out = np.zeros((3, FEATURES * FEATURES))
    for k, name in enumerate(COUNTS):
        out[k, sums["cell"].to_numpy()] = sums[name].to_numpy()
    both = out.reshape(3, FEATURES, FEATURES)
    return [m + np.triu(m, 1).T for m in both]


def estimated_prior(all_: np.ndarray, good: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among all texts, from counts of both by score, best first: where only positives score, all
    texts are as dense as the share times the positives. Of all thresholds the one with the lowest upper bound is taken
    (Hoeffding's, at confidence 1 - delta)."""
    a, g = np.cumsum(all_) / all_.sum(), np.cumsum(good) / good.sum()
    slack = math.sqrt(math.log(4 / delta) / 2) * (1 / math.sqrt(all_.sum()) + 1 / math.sqrt(good.sum()))
    some = g > 2 * slack
    if not some.any():
        return 1.0
    a, g = a[some], g[some]
    best = int(np.argmin((a + slack) / g))
    return float(min(1.0, max(1e-3, a[best] / g[best])))


def minimised(all_: np.ndarray, good: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 2000, rate: float = 0.05) -> np.ndarray:
    """The weights of the least non-negative risk, with the squared loss (1 - value)^2 / 4 of either class.

    The risk is prior * P+ + max(0, U- - prior * P-), P and U being means over trusted and all texts, + and - the loss if
    they were good or bad. Each is a quadratic form of the moments, so that the unbiased risk has a minimum in closed form; where
    the part for bad texts is negative there, what overfits is undone by gradient steps: up that part while it is
    negative, down the whole risk else, and the best weights met are kept.
    """
    u, p = all_ / all_[0, 0], good / good[0, 0]
    eye = np.eye(len(u)) * ridge
    loss = lambda m, w, sign: (1 - 2 * sign * (m[0] @ w) + w @ m @ w) / 4
    slope = lambda m, w, sign: (m @ w - sign * m[0]) / 2
    bad = lambda w: loss(u, w, -1) - prior * loss(p, w, -1)
    risk = lambda w: prior * loss(p, w, 1) + max(0.0, bad(w)) + ridge / 2 * w @ w
    w = np.linalg.solve(u / 2 + eye, prior * p[0] - u[0] / 2)
    if bad(w) >= 0:
        return w
    best, least = w, risk(w)
    for _ in range(steps):
        down = slope(u, w, -1) - prior * slope(p, w, -1)
        w = w + rate * down if bad(w) < 0 else w - rate * (prior * slope(p, w, 1) + down + ridge * w)
        if risk(w) < least:
            best, least = w, risk(w)
    return best


def ridge(good: np.ndarray) -> float:
    """Falls with the number of trusted texts, down to 1/1000."""
    return max(1e-3, 3 / good[0, 0])


def fit(rows: DataFrame, labels: DataFrame, max_rows: int = 40_000, folds: int = 4, held: int = 2) -> Model:
    """The model, from coded rows and the labels with crc32(doc_id) mod folds other than `held`.

    Trusted are the rows labelled good, at most max_rows ids (those with the smallest hashes), ids with both labels left
    out; unlabelled are all rows, whatever their labels. Equal texts count once, so that copies have no weight.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("q")).filter("_id is not null and q is not null")
    known = known.filter(F.crc32(F.col("_id").cast("string").cast("binary")) % folds != held).groupBy("_id").agg(F.min("q").alias("q"))
    known = known.filter("q = 1").orderBy(F.xxhash64("_id"), "_id").limit(max_rows).select("_id", F.lit(True).alias("_good"))
    texts = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id"), "left").groupBy("key", "codes").agg(F.max(F.coalesce("_good", F.lit(False))).alias("trusted"))
    texts = stored(texts.select("codes", "trusted", (F.pmod(F.col("key"), F.lit(2)) == 0).alias("half")), "quality-texts")
    all_, good, first = moments(texts)
    if not good[0, 0]:
        return Model()
    # told from all texts, trusted ones score high: where no bad text does, the share of good ones shows in the half that
    # hasn't been fitted
    half = first if 0 < first[0, 0] < good[0, 0] else good
    apart = np.linalg.solve(all_ / all_[0, 0] + half / half[0, 0] + np.eye(FEATURES) * ridge(half), half[0] / half[0, 0] - all_[0] / all_[0, 0])
    shared = rows.sparkSession.sparkContext.broadcast((apart, half is first))

    def bins(batches):
        total = np.zeros((2, 2001), np.int64)
        for batch in batches:
            if batch.num_rows:
                weights, split = shared.value
                at = np.clip(np.rint(1000 - 1000 * values(weights, batch.column(0))), 0, 2000).astype(np.int64)
                good, half = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                total[0] += np.bincount(at, minlength=2001)
                total[1] += np.bincount(at[good & ~half] if split else at[good], minlength=2001)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bin", "n", "good"])

    found = texts.mapInArrow(bins, "bin long, n long, good long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").toArrow()  # 2,001 rows at most
    prior = estimated_prior(found["n"].to_numpy(), found["good"].to_numpy())
    return Model(minimised(all_, good, prior, ridge(good)), prior)


def score_documents(rows: DataFrame, model: Model, folds: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each coded row."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)
    schema = StructType([rows.schema["doc_id"], StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            score = np.clip((1 + values(shared.value, batch.column(1))) / 2, 0, 1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=arrow_schema(schema))

    out = rows.select("doc_id", "codes").mapInArrow(run, schema)
    away = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return out.select("doc_id", away.alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 40_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score and predicted (1: good).

    Null texts count as empty; empty and very long texts are measured like others. A null id is in no fold that is held
    out and has no label. Rows that share an id share its label. Labels that are null, or both, are left out. An empty
    table gives an empty result. Columns other than id and text are ignored, labels' but doc_id and quality too.
    """
    rows = coded(docs, text_col, id_col)
    return score_documents(rows, fit(rows, labels, max_rows))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tarnlake.llm.common import arrow_schema, documents, slices, stored
from tarnlake.llm.vec import rolling, text_bytes, word_hashes, words

TOKEN = re.compile(r"\w+")
WORD = re.compile("[^\x20\t-\r]+")
#: Smallest 5-word hashes by which near copies among the labelled rows are found.
SKETCHES = 6
#: The similarity from which the later of two labelled texts is a near copy.
SAME = 0.8
#: Lengths of the first letters that are features too.
PREFIXES = (5, 6, 7)
#: Tokens whose scores a worker keeps.
MEMO = 200_000
SEGMENT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evalue", pa.float64())])


@dataclass
class Model:
    """weights: log-odds by feature, of either sign; a token scores that of its features which is farthest from zero, or
    -drift if it has none, so that segments end. rate: the extreme-value law's scale (lambda), size: its K. pivot: the
    p-value that gets a score of 0.5."""

    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] | None = field(default=None, repr=False, compare=False)
    drift: float = 0.05
    rate: float = 1.0
    size: float = 1.0
    pivot: float = 0.01


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def features(token: str) -> list[str]:
    """The token, and its first letters if it has more: a marked stem also counts in words never seen."""
    return [token, *(f"^{token[:k]}" for k in PREFIXES if len(token) > k)]


class Scores(dict):
    """The score of each token met so far, 0 without a weight; emptied by hits_of when it has MEMO tokens."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        weights = self.weights
        self[token] = best = max((weights[f] for f in features(token) if f in weights), key=abs, default=0.0)
        return best

    def __reduce__(self):
        return Scores, (self.weights,)


def hits_of(model: Model, toks: list[str]) -> list[tuple[int, float]]:
    """Place and score of the tokens with a weight."""
    if model.memo is None or len(model.memo) > MEMO:
        model.memo = Scores(model.weights)
    return [(i, x) for i, x in enumerate(map(model.memo.__getitem__, toks)) if x]


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence that scores -drift but at hits (place, score of
    either sign), by Ruzzo and Tompa's method with linked indices: one pass, in time linear in the hits."""
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total, last = 0.0, 0
    for place, score in hits:
        total -= drift * (place - last)
        if score < 0:
            total, last = total + score, place + 1
            continue
        left, right, start = total, total + score, place
        total, last = right, place + 1
        # a segment's link is the nearest one before it with a smaller sum before: those between can't be joined with what
        # comes later either, so they are passed over once
        j = len(out) - 1
        while j >= 0 and out[j][2] >= left:
            j = out[j][4]
        while j >= 0 and out[j][3] < right:
            start, _, left, _, link = out[j]
            del out[j:]
            j = link
        out.append((start, place + 1, left, right, j))
    return [(s, e, b - a) for s, e, a, b, _ in out]


def log_odds(toxic: Column, clean: Column, n_toxic: float, n_clean: float, prior: float) -> tuple[Column, Column]:
    """Log-odds ratio of each token with an informative Dirichlet prior (`prior` times its count in both classes), and z-scores."""
    a, prior = (toxic + clean) * prior, prior * (n_toxic + n_clean)
    delta = F.log((toxic + a) / (n_toxic + prior - toxic - a)) - F.log((clean + a) / (n_clean + prior - clean - a))
    return delta, delta / F.sqrt(1 / (toxic + a) + 1 / (clean + a))


def similarity(a: str, b: str) -> float:
    """The share of 5-word shingles that two texts have in common."""
    x, y = ({*zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)} for w in (WORD.findall(a), WORD.findall(b)))
    return len(x & y) / len(x | y) if x and y else 0.0


def p_value(model: Model, best: float, length: int) -> float:
    """The chance that a clean text of so many tokens has a segment with such a score (Karlin and Altschul)."""
    if best <= 0:
        return 1.0
    return -math.expm1(-model.size * max(length, 1) * math.exp(-model.rate * best))


def scored(model: Model, text: str) -> tuple[float, list[tuple[int, int, float, float]]]:
    """Score from 0 to 1, and the segments with E-values."""
    toks = tokens(text)
    segments = maximal_segments(hits_of(model, toks), model.drift)
    p = p_value(model, max((s[2] for s in segments), default=0.0), len(toks))
    return model.pivot / (model.pivot + p), [(s, e, x, model.size * len(toks) * math.exp(-model.rate * x)) for s, e, x in segments]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, prior: float = 0.1, least_z: float = 3.0, text_col: str = "text", id_col: str = "doc_id", folds: int = 5) -> Model:
    """The model, from labelled rows whose crc32(id) mod `folds` isn't 0.

    max_rows bounds the labelled rows used (those with the smallest hashes of their ids, so that any corpus is sampled
    evenly). Every feature whose z-score is at least least_z or at most -least_z has a weight. Near copies (a row that
    shares any of its SKETCHES smallest 5-word hashes with an earlier one, and of whose 5-word shingles SAME are the same, which is checked exactly) count
    once, so that a text copied a thousand times is no evidence for its words; all others count. Rows that share an id count by their texts. Labels that are null or contradict each other are left
    out. Without labels of both classes the model has no weights.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic is not null")
    known = known.filter(F.crc32(F.col("_id").cast("string")) % folds != 0)
    known = known.groupBy("_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = d.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text").withColumn("key", F.xxhash64("text")).dropDuplicates(["doc_id", "key"])

    def sketch(batches):
        for batch in slices(batches, 2):
            data, offsets = text_bytes(batch.column(2))
            first, last, doc = words(data, offsets)
            h = word_hashes(data, first, last, 1)
            low = np.full((batch.num_rows, SKETCHES), np.iinfo(np.uint64).max, np.uint64)
            for j in range(SKETCHES):
                grams = rolling(h, 5, 2 + j)
                own = doc[: len(grams)] == doc[4:][: len(grams)] if len(grams) else np.empty(0, bool)
                np.minimum.at(low[:, j], doc[: len(grams)][own], grams[own])
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SKETCHES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(low.view(np.int64).ravel()))], ["doc_id", "toxic", "text", "key", "sketch"])

    sample = stored(sample.mapInArrow(sketch, StructType([*sample.schema.fields, StructField("sketch", ArrayType(LongType()))])), "toxicity-sample")
    none = F.lit(-1).cast("bigint")  # the sketch of texts under five words, which aren't compared
    uid = F.struct("doc_id", "key")
    each = sample.select(uid.alias("uid"), F.posexplode("sketch").alias("j", "sketch")).filter(F.col("sketch") != none)
    first = each.groupBy("j", "sketch").agg(F.min("uid").alias("first"))
    pairs = each.join(first, ["j", "sketch"]).filter("uid > first").select("uid", "first").distinct()  # SKETCHES a row at most
    own, other = sample.select(uid.alias("uid"), F.col("text").alias("a")), sample.select(uid.alias("first"), F.col("text").alias("b"))
    near = pairs.join(own, "uid").join(other, "first").select("uid", "a", "b")

    def copies(batches):
        for batch in slices(slices(batches, 1), 2):
            yield batch.filter(pa.array([similarity(a, b) >= SAME for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])).select([0])

    later = near.mapInArrow(copies, StructType([near.schema["uid"]])).distinct().select(F.col("uid").alias("_later"))
    once = sample.drop("sketch").join(later, uid == F.col("_later"), "left_anti").drop("key")

    def count(batches):
        for batch in slices(batches, 2):
            by = {0: Counter(), 1: Counter()}
            docs_by: Counter = Counter()
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by[int(toxic == 1)].update({f for t in set(tokens(text)) for f in features(t)})
                docs_by[int(toxic == 1)] += 1
            keys = [*(by[0].keys() | by[1].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(["", *keys], pa.string()), pa.array([docs_by[1], *(by[1][k] for k in keys)], pa.int64()), pa.array([docs_by[0], *(by[0][k] for k in keys)], pa.int64())], ["token", "toxic", "clean"])

    counts = once.mapInArrow(count, "token string, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = stored(counts, "toxicity-counts")
    of = lambda c, docs: F.max(F.when(F.col("token") == "", F.col(c))) if docs else F.sum(F.when(F.col("token") != "", F.col(c)))
    totals = counts.agg(of("toxic", False).alias("t"), of("clean", False).alias("c"), of("toxic", True).alias("dt"), of("clean", True).alias("dc")).first()
    if not totals.dt or not totals.dc or not totals.t or not totals.c:
        return Model()
    delta, z = log_odds(F.col("toxic"), F.col("clean"), float(totals.t), float(totals.c), prior)
    # Only what stands out leaves Spark: a feature needs more than a dozen texts of the bounded sample to get so far.
    found = counts.filter("token <> ''").select("token", delta.alias("delta"), z.alias("z")).filter(F.abs("z") >= least_z).collect()
    model = Model({r.token: r.delta for r in sorted(found, key=lambda r: r.token)})
    return _calibrated(model, once) if any(w > 0 for w in model.weights.values()) else Model()


def root_of(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over tokens of clean texts, the extreme-value law's scale."""
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if float((share * np.exp(np.minimum(mid * scores, 700))).sum()) < 1 else (low, mid)
    return high


def _calibrated(model: Model, sample: DataFrame) -> Model:
    """The scale from how often clean texts' tokens have each score; K so that clean texts have as many hits as the law
    expects; and the pivot that errs least on the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def best(batches):
        """A row per text (best segment, tokens), and a row per score that tokens of clean texts have (score, how many)."""
        for batch in slices(batches, 2):
            rows, seen = [], Counter()
            for toxic, toks in zip(batch.column(1).to_pylist(), map(tokens, batch.column(2).to_pylist()), strict=True):
                hits = hits_of(shared.value, toks)
                rows.append((int(toxic == 1), max((s[2] for s in maximal_segments(hits, shared.value.drift)), default=0.0), len(toks)))
                if toxic != 1:
                    seen.update(x for _, x in hits)
                    seen[-shared.value.drift] += len(toks) - len(hits)
            rows += [(-1, x, n) for x, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["toxic", "best", "length"])

    found = stored(sample.mapInArrow(best, "toxic bigint, best double, length bigint"), "toxicity-best")
    seen = found.filter("toxic = -1").groupBy("best").agg(F.sum("length").alias("n")).toPandas()  # a row per weight at most, and one
    rows = found.filter("toxic >= 0").toPandas().sort_values(["best", "length", "toxic"], kind="stable")  # as many short rows as the sample has
    # each weight's tokens count half a time more, as those of the toxic class may never occur in clean texts
    by = dict.fromkeys(model.weights.values(), 0.5)
    for x, n in zip(seen.best, seen.n, strict=True):
        by[x] = by.get(x, 0.0) + n
    scores, counts = np.array(sorted(by)), np.array([by[x] for x in sorted(by)])
    model.rate = root_of(scores, counts / counts.sum())
    least = min(w for w in model.weights.values() if w > 0)
    clean = rows[rows.toxic == 0]
    model.size = float(max(1.0, (clean.best >= least).sum()) / max(1.0, clean.length.sum()) * math.exp(min(700.0, model.rate * least)))
    p = np.array([p_value(model, b, n) for b, n in zip(rows.best, rows.length, strict=True)])
    order = np.argsort(p, kind="stable")
    toxic = rows.toxic.to_numpy()[order]
    # Errors if the first i are called toxic; the pivot lies between two p-values that differ.
    errors = np.concatenate([[toxic.sum()], toxic.sum() - np.cumsum(toxic) + np.cumsum(1 - toxic)]).astype(float)
    q = p[order]
    errors[1:-1][q[1:] == q[:-1]] = np.inf
    errors[-1] = np.inf if q[-1] >= 1 else errors[-1]  # a text without any hit is never called toxic
    i = int(np.argmin(errors))
    low, high = (q[i - 1] if i else q[0] / 10), (q[i] if i < len(q) else 1.0)
    model.pivot = float(min(0.9, math.sqrt(max(low, 1e-300) * max(high, 1e-300))))
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", folds: int = 5, alpha: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_passages, and passages (token start, end, score, E-value).

    Whole texts are scanned once each, in time linear in their tokens, without any shuffle; the model is broadcast, whose
    weights fit's max_rows bounds. A passage is a maximal-scoring segment with an E-value of alpha at most; the score
    is pivot / (pivot + p), p being the p-value of the best segment. Null and empty texts get the score of a text
    without any hit. A null id is not held out. Rows are independent; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 1):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                score, segments = scored(shared.value, text)
                scores.append(score)
                passages.append([dict(zip(("start", "end", "score", "evalue"), s, strict=True)) for s in segments if s[3] <= alpha])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(SEGMENT))], ["doc_id", "score", "passages"])

    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:bigint,end:bigint,score:double,evalue:double>>"
    out = d.mapInArrow(run, schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under 0.5; null and empty texts stay. Rows are
    independent, so null or repeated ids need no rule; an empty table gives an empty result."""
    at = docs.columns.index(text_col)
    target = arrow_schema(docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, at):
            keep = [scored(shared.value, t or "")[0] < 0.5 for t in batch.column(at).to_pylist()]
            batch = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target, strict=True)], schema=target)

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).drop("passages")

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.cases import awkward, documents

from tarnlake.llm.toxicity import Model, drop_toxic, fit, log_odds, maximal_segments, p_value, score_documents, scored


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best, then the same to its left and right."""
    out = []

    def find(low, high):
        best, at = 0.0, None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > best + 1e-12:
                    best, at = total, (i, j + 1)
        if at:
            find(low, at[0])
            out.append((*at, round(best, 9)))
            find(at[1], high)

    find(0, len(scores))
    return out


def test_segments_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        hits = [(i, float(rng.choice([-2, 1, 2, 3, 5])) + float(rng.random())) for i in range(n) if rng.random() < 0.35]
        scores = [-0.83] * n
        for i, x in hits:
            scores[i] = x
        assert [(s, e, round(x, 9)) for s, e, x in maximal_segments(hits, 0.83)] == brute_segments(scores)
    assert maximal_segments([], 1.0) == []


def test_segments_take_linear_time():
    """Hits far apart leave as many open segments as there are hits; each is passed over once."""
    import time

    rng = np.random.default_rng(1)
    hits = [(60 * i, 1.0 + float(x)) for i, x in enumerate(rng.random(200_000))]
    began = time.process_time()
    assert len(maximal_segments(hits, 0.05)) == len(hits)  # nothing reaches from one hit to the next
    assert len(maximal_segments(hits, 0.02)) < len(hits)  # some do
    falling = [(i, 1.0 if i % 2 else -1.0 - i * 1e-6) for i in range(200_000)]
    maximal_segments(falling, 0.0)
    assert time.process_time() - began < 15


def test_labelled_rows_stay_but_for_near_copies(spark):
    """Texts that share a passage all count; of near copies, and of one text's copies, the first; rows that share an id count by their texts."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"own{i}x{j} vilex" if i % 2 else f"own{i}x{j}" for j in rng.integers(0, 99, 60))) for i in range(200)]
    long = " ".join(f"w{i}" for i in range(300))
    rows += [(1000 + i, long + f" tail{i}") for i in range(50)] + [(2000, "first text of an id it shares"), (2000, "second text with other words here"), (2000, "first text of an id it shares")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2 == 1 and i < 200)) for i, _ in {r[0]: r for r in rows}.items()], "doc_id bigint, toxic int")
    seen = []
    from tarnlake.llm import toxicity

    original = toxicity._calibrated
    try:
        toxicity._calibrated = lambda model, sample: seen.append(sample.select("doc_id", "text").collect()) or original(model, sample)
        one, two = fit(docs, labels), fit(docs.repartition(5), labels)
    finally:
        toxicity._calibrated = original
    used = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    ids = sorted(r.doc_id for r in seen[0])
    assert ids == sorted([i for i in range(200) if used(i)] + [min(1000 + i for i in range(50) if used(1000 + i))] + [2000] * (2 * used(2000)))
    assert one.weights == two.weights and one.pivot == two.pivot


def test_log_odds_prior_shrinks(spark):
    df = spark.createDataFrame([(0, 50, 1), (1, 1, 0), (2, 5, 50), (3, 2, 500)], "i int, t bigint, c bigint")
    rows = df.select(*log_odds(F.col("t"), F.col("c"), 1000.0, 9000.0, 0.1)).collect()
    delta, z = zip(*rows, strict=True)
    assert delta[0] > delta[2] and z[0] > 4 > z[1] > z[2] and delta[3] < 0 and z[3] < -3


def test_p_values():
    m = Model({"bad": 4.0}, rate=1.5, size=0.01)
    assert p_value(m, 0.0, 10) == 1.0 and p_value(m, 8.0, 10) < p_value(m, 4.0, 10) < p_value(m, 4.0, 1000) < 1
    assert math.isclose(p_value(m, 40.0, 10), 0.1 * math.exp(-60), rel_tol=1e-6)


def corpus(spark, n=1500):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(vocabulary, rng.integers(20, 200)).tolist()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["vilex", "nastyy", "grimme"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_determinism(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels)
    assert {"vilex", "nastyy", "grimme"} <= set(model.weights)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score_documents(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = {r.doc_id for r in drop_toxic(awkward(docs), model).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    again = fit(docs.repartition(7), labels.repartition(3))
    assert again.weights.keys() == model.weights.keys()


def brute_model(rows, labels, prior=0.1, least_z=3.0, drift=0.05):
    """Weights, scale and K of a corpus without near copies, from their definitions."""
    def feats(t):
        return {t, *("^" + t[:k] for k in (5, 6, 7) if len(t) > k)}

    train = [(re.findall(r"\w+", x.lower()), labels[i]) for i, x in rows if zlib.crc32(str(i).encode()) % 5]
    counts = [Counter(f for toks, y in train if y == label for f in {f for t in toks for f in feats(t)}) for label in (0, 1)]
    n0, n1 = (sum(c.values()) for c in counts)
    weights = {}
    for f in counts[0].keys() | counts[1].keys():
        t, c, p = counts[1][f], counts[0][f], prior * (n0 + n1)
        a = prior * (t + c)
        delta = math.log((t + a) / (n1 + p - t - a)) - math.log((c + a) / (n0 + p - c - a))
        if abs(delta) / math.sqrt(1 / (t + a) + 1 / (c + a)) >= least_z:
            weights[f] = delta

    def token(t):
        return max((weights[f] for f in feats(t) if f in weights), key=abs, default=-drift)

    clean = Counter(token(t) for toks, y in train if not y for t in toks)
    for w in set(weights.values()):
        clean[w] += 0.5
    total, low, high = sum(clean.values()), 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * math.exp(mid * x) for x, n in clean.items()) < total else (low, mid)
    best = [(max((b[2] for b in brute_segments([token(t) for t in toks])), default=0.0), len(toks)) for toks, y in train if not y]
    least = min(w for w in weights.values() if w > 0)
    size = max(1, sum(b >= least for b, _ in best)) / sum(n for _, n in best) * math.exp(high * least)
    return weights, token, high, size


def test_every_score_against_brute_force(spark):
    docs, labels = corpus(spark, 500)
    # "finee" is marked as clean: a token of negative log-odds
    docs = docs.join(labels, "doc_id").withColumn("text", F.when(F.col("toxic") == 0, F.concat("text", F.lit(" finee finee"))).otherwise(F.col("text"))).drop("toxic")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weights, token, rate, size = brute_model(rows, {r.doc_id: r.toxic for r in labels.collect()})
    model = fit(docs, labels)
    assert model.weights.keys() == weights.keys() and weights["finee"] < 0 < weights["vilex"]
    assert all(math.isclose(model.weights[k], weights[k], rel_tol=1e-9) for k in weights)
    assert math.isclose(model.rate, rate, rel_tol=1e-6) and math.isclose(model.size, size, rel_tol=1e-6)
    got = {r.doc_id: r.score for r in score_documents(docs, model).collect()}
    for i, text in rows:
        toks = re.findall(r"\w+", text.lower())
        best = max((b[2] for b in brute_segments([token(t) for t in toks])), default=0.0)
        p = 1 - math.exp(-size * len(toks) * math.exp(-rate * best)) if best > 0 else 1.0
        assert math.isclose(got[i], model.pivot / (model.pivot + p), rel_tol=1e-4)


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, 600)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert fit(docs, labels).weights == fit(docs, flipped).weights


def test_awkward_rows(spark):
    docs = awkward(documents(spark))
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 0), (2, 1), (None, 1)], "doc_id bigint, toxic int")
    model = fit(docs, labels)
    rows = score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score < 0.5 for r in rows)
    assert score_documents(documents(spark, []), model).count() == 0 and scored(model, "")[1] == []
    assert fit(documents(spark, []), labels).weights == {}

"""The pipeline's stages, each on what the one before keeps, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tests.llm import test_line_dedup, test_near_dedup, test_pii
from tests.llm.cases import documents
from tokenizers import Tokenizer

import corpus_pipeline
from tarnlake.llm import pii
from tarnlake.llm.common import clear_scratch, scratch_count
from tarnlake.llm.toxicity import features, fit


def written(df, tmp_path, name):
    df.write.parquet(f"file://{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"file://{tmp_path}/{name}")


def best_run(model, text):
    """The largest sum of neighbouring tokens' scores, by Kadane's method, and the number of tokens."""
    toks = re.findall(r"\w+", text.lower())
    best = here = 0.0
    for t in toks:
        here = max(0.0, here + max((model.weights[f] for f in features(t) if f in model.weights), key=abs, default=-model.drift))
        best = max(best, here)
    return best, len(toks)


def is_toxic(model, text):
    best, n = best_run(model, text)
    p = 1 - math.exp(-model.size * max(n, 1) * math.exp(-model.rate * best)) if best > 0 else 1.0
    return model.pivot / (model.pivot + p) >= 0.5


def redacted(rows):
    """Texts without personal data, from the tests' own spans and all texts' votes."""
    coded = Counter((k, c) for t in rows.values() for _, k, _, c, _ in pii.candidates(t))
    chance = pii.fit([(*key, n) for key, n in coded.items()])
    out = {}
    for i, t in rows.items():
        spans = [(s, k, e) for s, k, e in test_pii.plain(t)] + [(s, k, e) for s, k, e, c in test_pii.plain_added(t) if chance[k * pii.CODES + c] >= 0.5]
        at, parts = 0, []
        for s, k, e in sorted(spans):
            if s >= at:
                parts += [t[at:s], f"[{pii.KINDS[k].upper()}]"]
                at = e
        out[i] = "".join(parts) + t[at:]
    return out


def test_stages(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]

    one = written(stages["toxicity"](spark, docs, sf_small), tmp_path, "one")
    model = fit(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    clean = {r.doc_id for r in docs.collect() if not is_toxic(model, r.text or "")}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == clean

    two = written(stages["line_dedup"](spark, one, sf_small), tmp_path, "two")
    want = {k: text for (k, _, _, text) in test_line_dedup.brute(one.collect())}
    assert two.columns == columns and {str(r.doc_id): r.text for r in two.collect()} == want

    three = written(stages["near_dedup"](spark, two, sf_small), tmp_path, "three")
    kept = {k for k, _, _, keep in test_near_dedup.brute(two.collect()) if keep}
    assert three.columns == columns and {str(r.doc_id) for r in three.collect()} == kept

    four = written(stages["pii"](spark, three, sf_small), tmp_path, "four")
    assert four.columns == columns and four.count() == three.count()
    before = {r.doc_id: r.text for r in three.collect()}
    after = {r.doc_id: r.text for r in four.collect()}
    assert after == redacted(before) and after != before

    five = stages["packing"](spark, four, sf_small).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in four.collect()}
    pieces, sequences = {}, {}
    for r in five:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gapless = lambda parts: [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
    assert pieces.keys() == ids.keys() and all(gapless(p) and sum(n for _, n in p) == len(ids[k]) for k, p in pieces.items())
    assert all(gapless(p) and sum(n for _, n in p) <= 2048 for p in sequences.values())

    clear_scratch(spark)
    whole = corpus_pipeline.run(spark, sf_small)
    assert scratch_count(spark) == 1  # what the last stage reads
    whole = whole.collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, whole)) == sorted(map(key, five))


def test_toxic_documents_go(spark):
    """On a table with enough labels to learn from."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = {r.doc_id for r in docs.collect() if not is_toxic(model, r.text or "")}
    left = corpus_pipeline.toxicity(spark, docs, folder)
    assert {r.doc_id for r in left.select("doc_id").collect()} == clean and 0.8 < len(clean) / docs.count() < 1


def test_empty_and_null_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    for name, rows in (("none", []), ("few", [(1, None), (2, ""), (None, "x")])):
        folder = f"file://{tmp_path}/{name}"
        documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.count() == (0 if not rows else 2)


def test_planted_documents(spark, tmp_path):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"{a}{b}" for a, b in rng.choice(["al", "be", "ri", "to", "su", "ne", "ko", "mi"], (n, 2)))
    rows = [(i, text(120)) for i in range(300)]
    base = rows[0][1].split()
    rows += [(1000 + i, " ".join(w if j != 5 * i else f"edit{i}" for j, w in enumerate(base))) for i in range(20)]
    rows += [(2000 + i, text(80) + " vilex grimme " + text(10)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _ in rows if i < 300 or i % 2], "doc_id bigint, toxic int")
    folder = f"file://{tmp_path}/planted"
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    assert ids == set(range(300))

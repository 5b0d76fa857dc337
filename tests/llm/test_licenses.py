import random
import re
import time

from tests.llm.cases import awkward, documents

from tarnlake.llm import licenses
from tarnlake.llm.licenses import CLASSES, SHINGLE, SPAN, TEMPLATES, class_of, collision, license_matches


def tokens(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def grams(ws, size):
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def brute(text, templates=TEMPLATES, least=0.8):
    """Templates whose shingles are contained to `least` around some start, of all starts."""
    ws, found = tokens(text), set()
    for number, (name, template) in enumerate(templates):
        t = tokens(template)
        size, pad = min(SHINGLE, len(t)), -(-len(t) // 4) + SPAN if len(t) >= SHINGLE else 0
        want, have = grams(t, size), grams(ws, size)
        if len(want & have) < least * len(want):
            continue
        if any(len(want & grams(ws[max(0, p - pad) : p + len(t) + pad], size)) >= least * len(want) for p in range(len(ws))):
            found.add((name, number))
    return found


def found(df):
    return {r.doc_id: {(m.name, m.template) for m in r.matches} for r in df.collect()}


def test_against_brute_force_at_every_start(spark, sf_small):
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        got = license_matches(docs)
        rows = docs.collect()
        assert got.count() == len(rows)
        assert found(got) == {r.doc_id: brute(r.text) for r in rows}


def test_templates_in_other_text(spark):
    other = " ".join(f"word{i}" for i in range(333))
    rows = [(i, f"{other} {text.upper()}\n\n{other}") for i, (_, text) in enumerate(TEMPLATES)]
    rows += [(100 + i, text) for i, (_, text) in enumerate(TEMPLATES)]
    mit = dict(enumerate(t for _, t in TEMPLATES))[4].split()
    rows += [(200, " ".join(w if i % 40 else "edited" for i, w in enumerate(mit))), (201, " ".join(mit[: len(mit) // 2]))]
    rows += [(202, " ".join(text for _, text in TEMPLATES)), (None, TEMPLATES[4][1]), (203, TEMPLATES[0][1]), (203, TEMPLATES[0][1]), (203, "none")]
    out = license_matches(documents(spark, rows)).collect()
    assert sorted(len(r.matches) for r in out if r.doc_id == 203) == [0, 1, 1]
    got = {r.doc_id: {(m.name, m.template) for m in r.matches} for r in out if r.doc_id != 203}
    for i, (name, _) in enumerate(TEMPLATES):
        assert (name, i) in got[i] and (name, i) in got[100 + i] and (name, i) in got[202]
        at = {m.template: m for r in out if r.doc_id == i for m in r.matches}[i]
        assert at.start == 333 and at.containment == 1.0  # the word at which the template begins
    assert ("MIT", 4) not in got[201] and ("MIT", 4) in got[None] and got == {i: brute(t) for i, t in rows if i != 203}


def test_recall_on_edited_licenses(spark):
    """Words replaced, dropped and added at random: of what brute force still finds, the bands retrieve 95 % or more."""
    rng, rows = random.Random(5), []
    for k in range(400):
        number = rng.randrange(len(TEMPLATES))
        words = TEMPLATES[number][1].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 20)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([["changed"], [], [words[i], "added"]])
        rows.append((k, " ".join([*(f"a{rng.random()}" for _ in range(rng.randrange(50))), *words, "the end"])))
    got, want = found(license_matches(documents(spark, rows))), {i: brute(t) for i, t in rows}
    assert all(got[i] <= want[i] for i in want)
    total = sum(map(len, want.values()))
    assert total > 300 and sum(len(got[i]) for i in want) / total >= 0.95


def test_many_templates_cost_no_planning(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    templates = [(f"L{i}", " ".join(rng.choices(words, k=rng.choice([3, 6, 20, 60, 400])))) for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + " " + templates[i][1] + " " + " ".join(rng.choices(words, k=40))) for i in range(0, 500, 5)]
    docs = documents(spark, rows)
    few = time.perf_counter()
    license_matches(docs, templates[:16])._jdf.queryExecution().executedPlan()
    few, many = time.perf_counter() - few, time.perf_counter()
    df = license_matches(docs, templates)
    df._jdf.queryExecution().executedPlan()
    many = time.perf_counter() - many
    assert many < 3 * few + 5
    got = found(df)
    assert all((f"L{i}", i) in got[i] for i, _ in rows)
    named = license_matches(docs, spark.createDataFrame(templates, "name string, text string"))
    assert all(any(m.name == f"L{r.doc_id}" for m in r.matches) for r in named.collect())


def test_no_templates_and_empty(spark):
    assert license_matches(documents(spark, [])).count() == 0
    assert all(not r.matches for r in license_matches(documents(spark), []).collect())


def test_no_python_in_the_plan(spark, sf_small):
    from tarnlake.llm.licenses import op3_licenses

    plan = op3_licenses(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_bands_are_enough():
    assert collision(0.5) > 0.99 and collision(1.0) == 1 and CLASSES[-1] == (16, 8, 8)
    assert [class_of(n) for n in (1, 4, 5, 22, 23, 500)] == [0, 0, 1, 1, 2, 2]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_more_bands_than_may_be_broadcast(spark, sf_small, monkeypatch):
    """The join by a shuffle gives the same rows, with a few times the texts' bytes shuffled, and no Python; for 600 templates of full length too."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    many = [(f"L{i}", " ".join(rng.choices(words, k=1500))) for i in range(600)]
    rows = [(i, " ".join(rng.choices(words, k=300)) + " " + many[i][1] + " " + " ".join(rng.choices(words, k=200))) for i in range(0, 600, 20)]
    rows += [(1000 + i, " ".join(rng.choices(words, k=2000))) for i in range(100)] + [(0, rows[0][1])]
    whole = lambda df: sorted(str(r) for r in df.collect())
    small = awkward(documents(spark)).unionByName(spark.read.parquet(f"{sf_small}/documents.parquet"), allowMissingColumns=True).unionByName(documents(spark, [(7000 + i, t) for i, (_, t) in enumerate(TEMPLATES)] * 2), allowMissingColumns=True)
    want = whole(license_matches(small))
    monkeypatch.setattr(licenses, "BROADCAST_BANDS", 0)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        df = license_matches(small)
        assert whole(df) == want and any("MIT" in r for r in want)
        size = sum(len(r.text or "") for r in small.collect())
        assert shuffled(spark) - before < 6 * size, (shuffled(spark) - before, size)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        docs = documents(spark, rows)
        got = license_matches(docs, many).collect()
        assert len(got) == len(rows) and all([(m.name, m.start, m.containment) for m in r.matches] == ([(f"L{r.doc_id}", 300, 1.0)] if r.doc_id < 1000 else []) for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)

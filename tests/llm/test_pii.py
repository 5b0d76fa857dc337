import hashlib
import re

import numpy as np
import pytest
from tests.llm.cases import awkward, documents

from tarnlake.llm.pii import CODES, EXTRAS, KINDS, LOOSE, base_spans, candidates, decode, expectation_maximisation, extras, fit, luhn, pii_spans, redact, train_classifier, votes

FORMS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def awkward_texts():
    rng = np.random.default_rng(11)
    parts = ["@", ".", "a", "b-c", "1", "23", "255", "256", " ", "-", "+", "(", ")", "x@y.z", "4111111111111111", "+1 (415) 555-0199", "10.0.0.1", "é", "\n", "00", "%"]
    return ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(4000)] + ["a@b.c@d.e", "a@@b.c", "x" * 3000, "1" * 5000, "+1" + "(" * 3000, "1.2.3.4.5.6.7.8", "..@a.b", "a@b..c", "a@b.c."]


def test_base_spans_equal_the_patterns():
    for text in awkward_texts():
        assert base_spans(text) == plain(text), text


def test_whole_table(spark, sf_small):
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        want = []
        for r in docs.collect():
            spans = plain(r.text or "")
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            want.append((str(r.doc_id), *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest(), tuple((s, KINDS[k], e) for s, k, e in spans)))
        got = []
        for r in pii_spans(docs).collect():
            base = tuple((f.start, f.kind, f.end) for f in r.found if f.base)
            got.append((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, base))
            assert [f.start for f in r.found] == sorted(f.start for f in r.found)
        assert sorted(got) == sorted(want)
    assert pii_spans(documents(spark, [])).count() == 0


def test_added_spans_come_from_votes():
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    kinds = [KINDS[k] for _, k, _, _, _ in candidates(f"x {secret} and 123-45-6789, call 415-555-0199, joe (at) mail (dot) com")]
    assert sorted(kinds) == ["email", "id", "phone", "secret"]
    assert candidates("no digits, no sign") == [] and candidates("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa") == []
    (row,) = candidates(secret)
    assert decode(row[3])[0][2] == 1 and not row[4]


def plain_added(text):
    """Looser spans with their codes, each compared with all spans so far."""
    taken = [(s, e) for s, _, e in plain(text)]
    out = []
    for kind, form in LOOSE:
        for m in re.finditer(form.pattern, text):
            if kind == 4 and not any(c.isdigit() and c.isascii() for c in m[0]):
                continue
            if all(e <= m.start() or m.end() <= s for s, e in taken):
                taken.append(m.span())
                out.append((m.start(), kind, m.end()))
    coded = []
    for s, kind, e in sorted(out):
        code = 0
        for value, size in [*((v + 1, 3) for v in votes(text, kind, s, e, False)), *zip(extras(text, s, e), EXTRAS)]:
            code = code * size + value
        coded.append((s, kind, e, code))
    return coded


def test_added_spans_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rng = np.random.default_rng(3)
    parts = ["123-45-6789", "000-00-0000", "415-555-0199", "(415) 555 0199", "ssn", "Mary Smith", "call", "key=", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "aaaaaaaaaaaaaaaaaaaaaaaa1", "joe (at) mail (dot) com", "x@y.com", "10.0.0.1", "\n", "word", "ship", "hotel"]
    more = [(10_000 + i, " ".join(rng.choice(parts, rng.integers(1, 30)))) for i in range(300)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    added = {i: plain_added(t) for i, t in rows.items()}
    coded = [(k, c) for i, t in rows.items() for _, k, _, c, _ in candidates(t)]
    for i, t in rows.items():
        assert [(s, k, e, c) for s, k, e, c, is_base in candidates(t) if not is_base] == added[i]
    chance = fit([(k, c, coded.count((k, c))) for k, c in set(coded)])
    want = {i: [(s, KINDS[k], e) for s, k, e, c in a if chance[k * CODES + c] >= 0.5] for i, a in added.items()}
    got = {r.doc_id: [(f.start, f.kind, f.end) for f in r.found if not f.base] for r in pii_spans(docs).collect()}
    assert got == want and 100 < sum(map(len, want.values())) < sum(map(len, added.values()))


def test_gazetteer_has_whole_words():
    vote = lambda text, kind: votes(text, kind, len(text) - 11, len(text), False)[2]
    assert vote("the ship 10.10.10.10", 1) == 0 and vote("hotel 415-555-019", 3) == 0 and vote("ips: 10.10.10.10", 1) == 1 and vote("Tel. 415-555-019", 3) == 1
    assert extras("Mary Smith 123-45-6789", 11, 22)[1] == 1 and extras("marys house 123", 12, 15)[1] == 1 and extras("primary 123-45-6789", 8, 19)[1] == 0


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.6])
    votes = np.where((rng.random((20_000, 3)) < right) == truth[:, None], 1, -1)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    post, likely = expectation_maximisation(np.zeros(len(table), int), table, counts.astype(float))
    assert np.abs(likely[1, :, 2] - right).max() < 0.05 and np.abs(likely[0, :, 0] - right).max() < 0.05
    w = train_classifier(np.hstack([np.ones((len(table), 1)), table]), post, counts.astype(float))
    assert w[1] > w[2] > w[3] > 0
    assert fit([]) == {}


def test_redaction(spark):
    rows = redact(awkward(documents(spark))).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert texts[15] == "mail [EMAIL] or [PHONE], ip [IP], card [CARD]." and texts[1] is None and texts[4] == "a"
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows) and "norm" in rows[0].asDict()
    assert redact(documents(spark, [])).count() == 0


def test_long_texts_take_linear_time():
    import time

    began = time.process_time()
    for text in ("1" * 300_000, "a." * 150_000 + "@", "1." * 150_000, "+1 " * 100_000, "A1" * 150_000, "1-" * 150_000, "123-45-6789\n" * 40_000, "@" * 300_000, "a@ " * 100_000, "x" * 300_000 + "@", "a@b.co " * 40_000 + "123-45-6789 " * 20_000):
        candidates(text)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("text, ok", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(text, ok):
    assert luhn(text) == ok

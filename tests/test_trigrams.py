"""Regex search by trigrams against a full scan."""

import random

import pytest

from tarnlake.operators.predicates import matches
from tarnlake.operators.trigrams import alternatives, candidates, grams, index, lowered, search
from tarnlake.session import table


def test_required_trigrams():
    assert alternatives("licen[sc]e|RESERVED") == [{"lic", "ice", "cen"}, grams("reserved")]
    assert alternatives("ab(cd|ef)+gh") is None and alternatives("(?:hello){0,3}") is None
    assert alternatives("abc(def)?ghi") == [{"abc", "ghi"}] and alternatives("(abc|dba)xyz") == [{"abc", "xyz"}, {"dba", "xyz"}]
    assert alternatives("abcd{2}") == [{"abc"}] and alternatives("(hello){2,}") == [grams("hello")]
    assert alternatives("a.c") is None and alternatives("(") is None and alternatives(r"\p{L}abc") is None and alternatives("(?x)a b c d") is None
    assert alternatives("(?=abc)abcd") == [grams("abcd")] and alternatives("(?i:abc)def") == [{"def"}]
    assert alternatives("(aa|bb|cc|dd)" * 5 + "xyz") is None


def test_letters_without_regard_to_case():
    assert lowered("KÉİſıΣςµß") == "kéisiσσμß"


@pytest.fixture(scope="module")
def posted(spark, sf_small, tmp_path_factory):
    docs = table(spark, sf_small, "documents").select("doc_id", "text")
    extra = [(9001, None), (None, "the licence of none"), (9002, ""), (9003, "ΛΟΓΟΣ Straße ſtop İstanbul"), (9003, "λόγος λογος again"), (9004, "x" * 100_000 + "needle in it")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).cache()
    return docs, index(docs, f"file://{tmp_path_factory.mktemp('index')}/p")


@pytest.mark.parametrize("pattern", ["licen[sc]e|RESERVED", "all rights", r"\bCC BY-NC \d\.\d", "a.c", "(idiot|clown).{0,40}the", "λογοσ|STRASSE", "stop|istanbul", "needle in", "nowhere at all", "nowhere|reserved", "(?:th|en)e{1,2}re", "[0-9]{4} [0-9]{4}", "été", r"example\.(com|net)$", "", "(ab", "^The "])
def test_equals_a_full_scan(posted, pattern):
    docs, table_ = posted
    if pattern == "(ab":
        assert candidates(table_, pattern) is None
        return
    want = docs.filter(matches("text", pattern))
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    assert key(search(docs, table_, pattern)) == key(want)


def test_random_pieces_are_found(posted):
    docs, table_ = posted
    rng, texts = random.Random(4), [r.text for r in docs.collect() if r.text and len(r.text) > 50]
    import re

    for _ in range(12):
        text = rng.choice(texts)
        at = rng.randrange(len(text) - 12)
        pattern = re.escape(text[at : at + 5].upper()) + ".{0,9}" + re.escape(text[at + 5 : at + 11])
        ids = candidates(table_, pattern)
        assert ids is None or search(docs, table_, pattern).filter(docs.text == text).count() > 0


def test_few_texts_are_read(posted):
    docs, table_ = posted
    for pattern in ("licen[sc]e|RESERVED", "needle in it", "(?:Apache|MIT) Licen[sc]e"):
        read, hit = candidates(table_, pattern).count(), docs.filter(matches("text", pattern)).count()
        assert read <= 0.25 * docs.count() and read >= hit - 1
    assert candidates(table_, "nowhere at all").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trigrams_of_many_texts_at_once(seed):
    """As text by text; letters of many scripts too, of which there are more than fit one number with the texts'."""
    from tarnlake.operators.trigrams import grams_of

    rng = random.Random(seed)
    letters = "abAB İıſΣςß" if seed < 5 else [chr(c) for c in range(32, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 40]))) for _ in range(seed * 20)] if seed < 5 else ["".join(letters)] * 8
    want = {}
    for i, t in enumerate(texts):
        for g in grams(lowered(t)):
            want.setdefault(g, []).append(i)
    found, starts, at = grams_of(texts)
    assert {g: at[a:b].tolist() for g, a, b in zip(found, starts, starts[1:], strict=False)} == want and len(found) == len(want)

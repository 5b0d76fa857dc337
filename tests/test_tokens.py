"""Counts by a vocabulary's longest pieces, and chunks that hold to them."""

import random

import pytest
from pyspark.sql import functions as F

from tarnlake.functions.tokens import SubwordCounter
from tarnlake.operators.chunking import Packer, chunk_documents
from tarnlake.session import table


def plain(word, pieces, style):
    """The longest piece at each place, by trying all lengths."""
    at, n = 0, 0
    word = {"end": f"{word}</w>", "begin": f"▁{word}"}.get(style, word)
    while at < len(word):
        for size in range(len(word) - at, 0, -1):
            part = word[at : at + size]
            if (f"##{part}" if style == "on" and at else part) in pieces:
                break
        else:
            size = 1
            if style == "end" and word[at:] == "</w>":
                return n
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("style", ["on", "end", "begin", "none"])
def test_against_all_lengths(style):
    rng = random.Random(6)
    bare = {"".join(rng.choices("abcé", k=rng.randrange(1, 6))) for _ in range(120)}
    mark = {"on": lambda p: f"##{p}", "end": lambda p: f"{p}</w>", "begin": lambda p: f"▁{p}", "none": lambda p: p}[style]
    pieces = bare | {mark(p) for p in bare if rng.random() < 0.6}
    count = SubwordCounter(pieces)
    for _ in range(500):
        words = ["".join(rng.choices("abcéx", k=rng.randrange(1, 15))) for _ in range(rng.randrange(5))]
        assert count("  ".join(words)) == 2 + sum(plain(w, pieces, style) for w in words), (words, style)


def vocabulary(spark, sf_small):
    """Beginnings and endings of the corpus's own words."""
    words = table(spark, sf_small, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(800).collect()
    return {p for r in words for i in range(1, len(r.w) + 1) for p in (r.w[:i], f"##{r.w[i:]}") if p.strip("#")}


def test_no_chunk_is_above_its_limit(spark, sf_small):
    """With hard limits no chunk has more tokens than it may, all words stay in their order, and texts that fit are as before."""
    count = SubwordCounter(vocabulary(spark, sf_small))
    rows = [(r.doc_id, r.text) for r in table(spark, sf_small, "documents").collect()] + [(9001, "x" * 3000 + " y. " + "word " * 900 + ". End it here.")]
    for most, lap in ((512, 64), (60, 16)):
        pack = Packer(max_tokens=most, min_tokens=1, overlap_tokens=lap, count=count, hard=True)
        for _, text in rows:
            assert all(count(c["content"]) <= most for c in pack(text))
            parts = pack.within(text)
            assert "".join("".join(parts).split()) == "".join(text.split()) and all(count(p) <= most for p in parts)  # nothing is lost or moved
            assert len(parts) <= 1 + 2 * count(text) // (most - 2) or "x" * 99 in text
    assert any(count(c["content"]) > 60 for _, t in rows for c in Packer(max_tokens=60, min_tokens=1, count=count)(t))  # the service's own limits are passed
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = chunk_documents(docs, max_tokens=512, min_tokens=1, overlap_tokens=64, count=count, hard=True).collect()
    assert out and all(count(r.content) <= 512 for r in out)


def test_files(tmp_path):
    (tmp_path / "a.json").write_text('{"model": {"vocab": {"in": 0, "##sulin": 1, "[UNK]": 2}}}')
    (tmp_path / "a.txt").write_text("in\n##sulin\n")
    for name in ("a.json", "a.txt"):
        assert SubwordCounter.from_file(str(tmp_path / name), special=0, lower=True)("INSULIN in") == 3
    with pytest.raises(ValueError):
        Packer(max_tokens=1, count=SubwordCounter(["a"]), hard=True).within("a b")

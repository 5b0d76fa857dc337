import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.cases import awkward, documents

from tarnlake.llm import spelling
from tarnlake.llm.spelling import Trie, neighbours, spelling_groups


def near(a, b):
    """Whether one letter inserted, deleted or replaced makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """The rule, word by word."""
    count: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        close = [o for o in words if near(w, o)]
        best = min(close, key=lambda o: (-words[o], o), default=None)
        out[w] = (best if best and words[best] >= 10 * n else None, n, len(close))
    rows = []
    for w, (form, n, close) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, close, words[form] if form else None))
    return sorted(rows, key=str)


def trie_of(words):
    data = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


@pytest.mark.parametrize("states", [7, 1 << 18])
def test_automata_meet_the_trie(monkeypatch, states):
    monkeypatch.setattr(spelling, "STATES", states)
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(400)} | {"a" * 30, "a" * 31, "ab" * 12, "ab" * 12 + "a"})
    trie = Trie.unpack(Trie(*trie_of(words), np.arange(len(words))).pack())
    a, b = neighbours(trie, *trie_of(words))
    got = sorted(zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(i, j) for i in range(len(words)) for j in range(len(words)) if near(words[i], words[j])]
    assert [trie.word(i) for i in range(len(words))] == words


def rows_with_variants():
    rng = np.random.default_rng(9)
    base = ["".join(rng.choice(list("abcdeéÿ"), rng.integers(7, 11))) for _ in range(25)]
    rows = []
    for i in range(120):
        word = base[rng.integers(0, 25)]
        many = [word] * int(rng.integers(1, 60))
        at = int(rng.integers(0, len(word)))
        many += [word[:at] + rng.choice(["", "x", word[at] + "y"]) + word[at + 1 :]] * 2
        rows.append((i if i % 9 else None, " ".join(many).replace("a", "A", 3)))
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb"]
    rows += [(700 + i, " ".join([w] * (5 * 11**i))) for i, w in enumerate(chain[1:], 1)] + [(600, "aaaaaaaa aaaaaaaa " + "z" * 200_000)] * 2
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_groups_equal_the_rule(spark, monkeypatch, small):
    """Nulls, empty and very long texts and words, ties, repeated rows, clashing columns; in one shard or in many, over several rounds."""
    if small:
        monkeypatch.setattr(spelling, "SHARD_WORDS", 10)
        monkeypatch.setattr(spelling, "ROUND_BYTES", 4000)
        monkeypatch.setattr(spelling, "BATCH", 16)
        monkeypatch.setattr(spelling, "HELD", 20)
    rows = rows_with_variants() + [(1, None), (2, ""), (3, "ABCDEFGHÉ abcdefghÉ abcdefghé ×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    docs = awkward(documents(spark, rows)).selectExpr("*", "1 as word", "2 as n", "3 as form", "4 as trie", "5 as shard")
    got = sorted((tuple(r) for r in spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == plain(rows)
    assert any(r[1] and r[1] != r[2] for r in got)  # a root beyond the form
    assert spelling_groups(documents(spark, [])).collect() == []


def test_shared_cases(spark):
    docs = awkward(documents(spark))
    got = sorted((tuple(r) for r in spelling_groups(docs).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 500)
    words = spark.range(6000).selectExpr("concat('word', translate(cast(id as string), '0123456789', 'abcdefghij')) as word", "id + 2 as n")
    tries = [Trie.unpack(bytes(r.trie)) for r in spelling.shards(words, 6000).collect()]
    assert sum(len(t.counts) for t in tries) == 6000 and max(len(t.counts) for t in tries) < 500 + spelling.BATCH
    assert len({t.word(i) for t in tries for i in range(len(t.counts))}) == 6000

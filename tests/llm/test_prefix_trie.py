import hashlib
import random
import zlib

import pytest

from tarnlake.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie's nodes straight from the rule."""
    turns: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    for own in turns.values():
        own.sort()
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = tuple((r, x) for _, _, r, x in turns.get(base, [])[:h] + own[h:])
    members: dict = {}
    for c, own in made.items():
        for d in range(len(own) + 1):
            members.setdefault(own[:d], []).append(c)
    children, leaves, saved = (dict.fromkeys(members, 0) for _ in range(3))
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, convs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
    ends = {key: ",".join(map(str, sorted(c for c in convs if made[c] == key))) for key, convs in members.items()}
    return sorted((min(v), len(k), min(members[k[:-1]]) if k else -99, len(v), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, v in members.items())


def check(df):
    got = trie.prefix_trie(df).collect()
    assert sorted(tuple(-99 if v is None else v for v in r) for r in got) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    return got


def test_awkward_rows(spark):
    """Nulls in any column, repeated turns and rows, negative ids, ids without turns of their own, clashing columns."""
    rng = random.Random(5)
    rows = [(rng.randint(-12, 40), rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["u", "a", None]), rng.choice(["x", "yé", None, ""])) for _ in range(500)]
    rows += [(None, 1, "u", "x"), (41, 0, "u", "alone"), (41, 0, "u", "alone"), (46, 0, "u", "long " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(df.selectExpr("*", "1 as digest", "2 as pos", "3 as n", "'x' as depth", "4 as _span", "5 as first", "6 as up"))
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    (only,) = trie.prefix_trie(spark.createDataFrame([(7, 0, "u", "x")], SCHEMA)).collect()  # its own turn is among those left out
    assert (only.conv_id, only.depth, only.parent_conv_id, only.n_convs, only.ends_sha256) == (7, 0, None, 1, hashlib.sha256(b"7").hexdigest())


@pytest.mark.parametrize("block", [3, 256])
def test_long_and_nested_conversations(spark, monkeypatch, block):
    """Conversations over many tasks, blocks and spans, each a beginning of the next, and a thousand copies of one."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SPAN", 8)
    monkeypatch.setattr(trie, "JOINED", 100)
    rows = [(5 * i, t, "u", f"t{t}") for i in range(1, 30) for t in range(3 * i)]
    rows += [(1000, t, "u", f"q{t}") for t in range(150)] + [(1005, t, "u", f"q{t}") for t in range(120)] + [(1005, 200 + t, "u", "z") for t in range(30)]
    rows += [(5 * i, 0, "u", "same") for i in range(300, 1300)]
    random.Random(3).shuffle(rows)
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert max(r.n_convs for r in got if r.depth == 1) == 1000


def test_a_conversation_over_all_tasks(spark):
    """Blocks know their first turn's number though a task can't, and no block holds more than BLOCK turns."""
    turns = spark.range(5000).selectExpr("5L as conv_id", "id as turn", "unhex(md5(cast(id as string))) as digest", "id as size").repartition(7)
    blocks = sorted(trie.blocks_of(turns).collect(), key=lambda r: r.pos)
    assert sum(r.n for r in blocks) == 5000 and max(r.n for r in blocks) <= trie.BLOCK
    assert [r.pos for r in blocks] == [sum(b.n for b in blocks[:i]) for i in range(len(blocks))]
    assert b"".join(bytes(r.digests) for r in blocks) == b"".join(hashlib.md5(str(i).encode()).digest() for i in range(5000))

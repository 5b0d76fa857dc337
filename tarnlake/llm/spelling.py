"""Spelling variants: each word's distance-one automaton meets tries of the vocabulary, a shard at a time."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tarnlake.llm.common import arrow_schema, as_batch, documents, slices, stored

#: Letters of words; only A-Z are lower-cased. All are in Latin-1, so a letter is a byte in the tries.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, EVERY, RATIO = 7, 2, 31, 10
#: Words and letters that a shard has at most (its arrays: 9 bytes a node, so 40 MB, or those of one word that is longer).
SHARD_WORDS, SHARD_LETTERS = 1 << 18, 1 << 22
#: Bytes of shards that are broadcast at once.
ROUND_BYTES = 64 << 20
#: Distinct words that a counting task holds before it hands on their counts.
HELD = 200_000
#: Words whose automata are run at once, and states that one step takes.
BATCH, STATES = 4096, 1 << 18
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word and n, from whole texts: runs of letters, lower-cased; where the crc32 h of id:run is a multiple of EVERY, the
    run's letter h % length is left out. Words of LEAST_LENGTH letters and LEAST_COUNT occurrences at least."""
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    target, form = arrow_schema(schema), re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def count(batches):
        held: Counter = Counter()
        for batch in slices(batches, 1):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                begin = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(form.findall(text.translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield as_batch({"word": [*held], "n": [*held.values()]}, target)
                    held.clear()
        yield as_batch({"word": [*held], "n": [*held.values()]}, target)

    return d.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Trie:
    """Sorted words (Latin-1 bytes one after the other, with offsets) as arrays: node v's children are the nodes from
    first[v] to before first[v + 1], in the order of their letters; at[v] is the word that ends in v, or -1. Nodes are
    numbered level by level, so that a child's number follows its parent's and letter."""

    def __init__(self, letters: np.ndarray, offsets: np.ndarray, counts: np.ndarray):
        self.letters, self.offsets, self.counts = letters, offsets, counts
        lengths = np.diff(offsets)
        alive, group = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)  # words with more letters, and their node
        letter, first, at = [np.zeros(1, np.uint8)], [], [np.full(1, -1, np.int32)]
        total, depth = 1, 0
        base = 0  # of this level's nodes
        while len(alive):
            some = lengths[alive] > depth
            alive, group = alive[some], group[some]
            size = total - base
            if not len(alive):
                first.append(np.full(size, total, np.int64))
                break
            c = letters[offsets[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (c[1:] != c[:-1]) | (group[1:] != group[:-1])
            first.append(total + np.searchsorted(group[new], np.arange(base, total)))
            letter.append(c[new])
            base, group = total, total + np.cumsum(new) - 1
            total += int(new.sum())
            depth += 1
            own = np.full(total - base, -1, np.int32)
            end = lengths[alive] == depth
            own[group[end] - base] = alive[end]
            at.append(own)
        self.first = np.append(np.concatenate(first) if first else [], total).astype(np.int32)
        self.letter, self.at = np.concatenate(letter), np.concatenate(at)

    def pack(self) -> bytes:
        parts = [x.tobytes() for x in (self.letters, self.offsets.astype(np.int64), self.counts.astype(np.int64), self.first, self.letter, self.at)]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> Trie:
        ends = 48 + np.cumsum(np.frombuffer(data, np.int64, 6))
        out = cls.__new__(cls)
        kinds = (np.uint8, np.int64, np.int64, np.int32, np.uint8, np.int32)
        out.letters, out.offsets, out.counts, out.first, out.letter, out.at = (np.frombuffer(data[a:b], k) for a, b, k in zip([48, *ends[:-1]], ends, kinds, strict=True))
        return out

    def word(self, i: int) -> str:
        return self.letters[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("latin-1")


def neighbours(trie: Trie, letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word of the batch, word of the trie) that differ by one letter inserted, deleted or replaced, each once.

    A state is a word, a node, the letters of the word that are read, and whether the one edit is made. States are taken
    from a stack, the deepest first, STATES of them at a time: before the edit, a state goes on with every child, the one that
    the word names unchanged, all others as replaced or inserted letters; a deletion moves on in the word alone. After
    it, only the child that the word names is left. A letter is inserted at the end of a run of its like, and deleted at its
    end, so that no neighbour is met twice.
    """
    lengths = np.diff(offsets)
    none = np.empty(0, np.int64)
    n = len(lengths)
    if not n or len(trie.first) < 2:
        return none, none
    padded = np.append(letters, np.uint8(0))
    stack = [(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool))]
    left, right = [], []
    while stack:
        word, node, pos, edited = stack.pop()
        if len(word) > STATES:
            stack.append(tuple(x[STATES:] for x in (word, node, pos, edited)))
            word, node, pos, edited = (x[:STATES] for x in (word, node, pos, edited))
        whole = pos == lengths[word]
        found = edited & whole & (trie.at[node] >= 0)
        left.append(word[found])
        right.append(trie.at[node[found]].astype(np.int64))
        place = offsets[word] + pos
        parts = []
        fresh = ~edited
        # a deletion: the letter read next isn't needed
        drop = fresh & ~whole
        drop[drop] = (pos[drop] + 1 == lengths[word[drop]]) | (padded[place[drop]] != padded[place[drop] + 1])
        parts.append((word[drop], node[drop], pos[drop] + 1, np.ones(int(drop.sum()), bool)))
        # after the edit: the child named by the word, found by halving the children
        go = edited & ~whole
        w, v, p = word[go], node[go], pos[go]
        want, low, high = padded[place[go]], trie.first[v].astype(np.int64), trie.first[v + 1].astype(np.int64)
        end = high.copy()
        while len(low) and (low < high).any():
            mid = (low + high) >> 1
            less = (low < high) & (trie.letter[np.minimum(mid, len(trie.letter) - 1)] < want)
            low, high = np.where(less, mid + 1, low), np.where(less, high, np.maximum(mid, low))
        hit = low < end
        hit[hit] = trie.letter[low[hit]] == want[hit]
        parts.append((w[hit], low[hit], p[hit] + 1, np.ones(int(hit.sum()), bool)))
        # before it: all children
        w, v, p = word[fresh], node[fresh], pos[fresh]
        begin = trie.first[v].astype(np.int64)
        kids = trie.first[v + 1] - begin
        total = int(kids.sum())
        if total:
            child = np.repeat(begin - (np.cumsum(kids) - kids), kids) + np.arange(total)
            w, p = np.repeat(w, kids), np.repeat(p, kids)
            inside = p < lengths[w]
            same = inside & (trie.letter[child] == padded[offsets[w] + p])
            swap = inside & ~same
            parts.append((w[swap], child[swap], p[swap] + 1, np.ones(int(swap.sum()), bool)))
            more = ~same
            parts.append((w[more], child[more], p[more], np.ones(int(more.sum()), bool)))
            parts.append((w[same], child[same], p[same] + 1, np.zeros(int(same.sum()), bool)))
        joined = tuple(np.concatenate([x[i] for x in parts]) for i in range(4))
        if len(joined[0]):
            stack.append(joined)
    return np.concatenate(left), np.concatenate(right)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def shards(words: DataFrame, count: int) -> DataFrame:
    """Tries of the words, each of a range of them: shard (number), size (bytes) and trie."""
    schema = StructType([StructField("size", LongType()), StructField("trie", BinaryType())])
    target = arrow_schema(schema)

    def build(batches):
        letters, lengths, counts, held = [], [], [], 0

        def packed():
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            data = Trie(np.concatenate(letters), offsets, np.concatenate(counts)).pack()
            for x in (letters, lengths, counts):
                x.clear()
            return as_batch({"size": [len(data)], "trie": [data]}, target)

        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                a, offsets = _letters(part.column(0))
                letters.append(a)
                lengths.append(np.diff(offsets))
                counts.append(part.column(1).to_numpy())
                held += len(a)
                if held >= SHARD_LETTERS - (1 << 16) or sum(map(len, counts)) >= SHARD_WORDS:
                    yield packed()
                    held = 0
        if letters:
            yield packed()

    # words are Latin-1, so their order in UTF-8 is that of their bytes in Latin-1
    dealt = words.repartitionByRange(max(1, -(-count // SHARD_WORDS)), "word").sortWithinPartitions("word")
    return stored(dealt.select("word", "n").mapInArrow(build, schema).withColumn("shard", F.monotonically_increasing_id()), "spelling-shards")


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of each of the words (word, n).

    Tries are broadcast in rounds of ROUND_BYTES at most; in each, every word meets every shard of the round, and the
    tasks reduce its neighbours to their number and the best of them. A round's table is written before its broadcast goes.
    """
    spark = words.sparkSession
    count = words.count()
    table = shards(words, count)
    sizes = [(r.shard, r["size"]) for r in table.select("shard", "size").orderBy("shard").collect()]  # a row a shard
    groups: list[list[int]] = []
    room = 0
    for shard, size in sizes:
        if not groups or size > room:
            groups.append([])
            room = ROUND_BYTES
        groups[-1].append(shard)
        room -= size
    schema = StructType([StructField("word", StringType()), StructField("n", LongType()), StructField("near", LongType()), StructField("best_n", LongType()), StructField("best", StringType())])
    target, found = arrow_schema(schema), None
    for number, group in enumerate(groups):
        shared = spark.sparkContext.broadcast([bytes(r.trie) for r in table.filter(F.col("shard").isin(group)).select("trie").toLocalIterator()])

        def meet(batches, shared=shared, number=number):
            tries = [Trie.unpack(data) for data in shared.value]
            for whole in batches:
                for i in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(i, BATCH)
                    letters, offsets = _letters(batch.column(0))
                    near, best_n, best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
                    for trie in tries:
                        a, b = neighbours(trie, letters, offsets)
                        near += np.bincount(a, minlength=batch.num_rows)
                        order = np.lexsort((b, -trie.counts[b], a))  # a shard's words are numbered in their order
                        a, b = a[order], b[order]
                        top = np.ones(len(a), bool)
                        top[1:] = a[1:] != a[:-1]
                        for w, j in zip(a[top].tolist(), b[top].tolist(), strict=True):
                            n, form = int(trie.counts[j]), trie.word(j)
                            if best[w] is None or (-n, form) < (-best_n[w], best[w]):
                                best_n[w], best[w] = n, form
                    mask = np.array([x is None for x in best], bool)
                    rows = as_batch({"word": batch.column(0), "n": batch.column(1), "near": pa.array(near), "best_n": pa.array(best_n, mask=mask), "best": pa.array(best, pa.string())}, target)
                    yield rows if number == 0 else rows.filter(pa.array(~mask))

        part = stored(words.select("word", "n").mapInArrow(meet, schema), "spelling-near")
        shared.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))))
    out = found if len(groups) == 1 else found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), best.alias("b")).select("word", "n", "near", (-F.col("b.m")).alias("best_n"), F.col("b.form").alias("best"))
    enough = F.col("best_n") >= RATIO * F.col("n")
    return out.select("word", "n", F.col("near").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words with a form: forms are followed to the last, twice as far in each round. A form has RATIO
    times the word's n, so rounds are as few as the digits of the largest n need; a word has fewer neighbours than letters
    times twice the alphabet, so no key is hot."""
    links = stored(forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while links.filter("moved").take(1):
        next_ = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        links = stored(links.join(next_, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
    return links.select("word", "root")


def spelling_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of docs.

    A null text has no words; a null id counts as an empty string where ids are hashed. Rows are independent: repeated
    rows count again. Very long words are words like others. Among forms of equal n the first in code-point order is
    taken. An empty table has no words. Further columns are ignored.
    """
    words = stored(word_counts(docs, text_col, id_col), "spelling-words")
    forms = stored(variants(words), "spelling-forms")
    found = roots(forms).select(F.col("word").alias("_word"), "root")
    out = forms.join(found, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


def _crc_entry(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


_TABLE = "[" + ", ".join(f"{_crc_entry(i)}::BIGINT" for i in range(16)) + "]"
_STEP = f"xor({{0}} >> 4, {_TABLE}[1 + ({{0}} & 15)])"
_BYTES = "flatten(list_transform(string_split(doc || ':' || w, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [(192 | (unicode(s) >> 6))::BIGINT, (128 | (unicode(s) & 63))::BIGINT] END))"
_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT doc, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY doc, w),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, b: {_STEP.format(_STEP.format("xor(a, b)"))}), 4294967295::BIGINT) AS h FROM each),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM hashed),
words AS (SELECT w, sum(n)::BIGINT AS n FROM cut WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
gaps AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS g FROM (SELECT w, n, unnest(range(length(w)))::INT AS i FROM words)),
near AS (SELECT a.w, b.w AS o, b.n AS m FROM gaps a JOIN gaps b ON a.g = b.g AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM gaps a JOIN words b ON a.g = b.w UNION SELECT b.w, a.w, a.n FROM gaps a JOIN words b ON a.g = b.w),
best AS (SELECT w, o, m, row_number() OVER (PARTITION BY w ORDER BY m DESC, o) AS k, count(*) OVER (PARTITION BY w) AS c FROM near),
formed AS (SELECT w.w, w.n, coalesce(b.c, 0) AS c, CASE WHEN b.m >= 10 * w.n THEN b.o END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.w = w.w AND b.k = 1),
walk AS (SELECT w, form AS at FROM formed WHERE form IS NOT NULL UNION ALL SELECT walk.w, f.form FROM walk JOIN formed f ON f.w = walk.at WHERE f.form IS NOT NULL),
ends AS (SELECT walk.w, walk.at FROM walk JOIN formed f ON f.w = walk.at WHERE f.form IS NULL)
SELECT f.w AS word, f.form, coalesce(e.at, f.w) AS root, f.n, f.c AS n_near, f.form_n FROM formed f LEFT JOIN ends e ON e.w = f.w
"""

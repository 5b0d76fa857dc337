"""Packing of tokenised documents into sequences: first-fit decreasing, with a tournament tree over the bins."""

from __future__ import annotations

import zlib

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tarnlake.llm.common import arrow_schema, as_batch, documents, row_count, slices
from tarnlake.llm.pieces import PLAIN_BELOW, RankedMerges, le32

#: Characters that Python counts as white space and the vocabulary's own pattern may not.
ODD_SPACES = "\x1c\x1d\x1e\x1f\x85"


#: How the vocabulary's own pre-tokenizer splits lower-cased text; what lies between is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder(dict):
    """Token ids of texts, as little-endian unsigned 32-bit numbers, for a vocabulary that never joins characters
    across white space.

    Holds the ids of each distinct word, which is encoded when it is first asked for; emptied when it has max_words.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        merges = RankedMerges(path, WORD_PATTERN)
        self.bpe, self.split, self.end = merges.core._encode_single_piece, regex.compile(WORD_PATTERN).findall, merges.end
        self.id_bytes = [le32([i]) for i in merges.ids.tolist()]
        self.max_words = max_words

    def __missing__(self, word: str) -> bytes:
        if "<|" in word or max(word) >= PLAIN_BELOW:
            ids = le32(self.tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            ids = b"".join([self.id_bytes[r] for part in self.split(word.lower()) for r in self.bpe(part.encode() + self.end)])
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(c in text for c in ODD_SPACES):
                out.append(le32(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            if len(self) > self.max_words:
                self.clear()
            out.append(b"".join(map(self.__getitem__, text.split())))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size. Sizes are placed from large to small, ties in the given order, each into the first bin
    with room; a tournament tree holds the most room in each half of the bins, so that one placement takes log n steps.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, at = sizes[item], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[item] = at - leaves
        room[at] -= size
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
    return bins


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", max_tokens: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 17) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, with end_id appended, are cut into pieces of max_tokens and a rest. Documents are dealt at random
    (by a hash of id and content, so that a task run again deals alike) into groups of about group_docs, and
    first_fit_decreasing packs each group by itself; what is shuffled is one short row per piece. Sequences number
    group * 2^32 + bin; offsets in a sequence are gapless, larger pieces first.

    A null text counts as empty and gives one piece with end_id alone. Rows that repeat an id are documents of their
    own. A null id is kept. An empty table gives an empty result. Columns other than id and text are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    groups = max(1, -(-row_count(d) // group_docs))
    names = ("start", "length", "ids_crc32", "doc_tokens", "mark")
    schema = StructType([d.schema["doc_id"], *(StructField(n, LongType()) for n in names)])
    target = arrow_schema(schema)
    end = le32([end_id])

    def pieces(batches):
        for batch in slices(batches, 1):
            ids, rows = batch.column(0).to_pylist(), {f.name: [] for f in target}
            for doc_id, data in zip(ids, encoder(tokenizer_path).encode(batch.column(1).to_pylist()), strict=True):
                data += end
                total, mark = len(data) // 4, zlib.crc32(data)
                for start in range(0, total, max_tokens):
                    part = data[4 * start : 4 * (start + max_tokens)]
                    for name, value in zip(target.names, (doc_id, start, len(part) // 4, zlib.crc32(part), total, mark), strict=True):
                        rows[name].append(value)
            yield as_batch(rows, target)

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        group["bin"] = first_fit_decreasing(group["length"].tolist(), max_tokens)
        group = group.sort_values("bin", kind="stable")
        group["offset"] = group.groupby("bin")["length"].cumsum() - group["length"]
        group["sequence_id"] = group["grp"] * (1 << 32) + group["bin"]
        return group[[f.name for f in out]]

    out = StructType([d.schema["doc_id"], *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    dealt = d.mapInArrow(pieces, schema).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(groups)))
    return dealt.drop("mark").groupBy("grp").applyInPandas(packed, out)


def default_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_vocabulary("word_bpe_49k.json"))

"""Byte-level BPE of whole texts, reusing content-defined chunks that documents share."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarnlake.llm.common import arrow_schema, as_batch, documents, slices
from tarnlake.llm.packing import default_vocabulary
from tarnlake.llm.pieces import PLAIN_BELOW, RankedMerges, byte_alphabet, le32

#: How the vocabulary's own pre-tokenizer splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space between two non-spaces always begins a token of the vocabulary's pattern, so a cut before it is safe. (What
#: Python takes for white space includes all that the pattern does.)
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
# The second and third bytes of the ideographic comma and full stop, after E3, and of full-width , ! ? ; :
# after EF. Before them, after an ideograph or hiragana, which are letters, a token of the pattern always begins.
STOPS = np.zeros((2, 256, 256), bool)
STOPS[0, 0x80, [0x81, 0x82]] = True
STOPS[1, 0xBC, [0x8C, 0x81, 0x9F, 0x9B, 0x9A]] = True


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes before which a token surely begins: single spaces between characters of one byte (printable),
    of two (from U+00C0) or of three (U+4000 to U+D7FF), none of which is white space; and the STOPS after a letter."""
    n = len(data)
    if n < 8:
        return np.empty(0, np.int64)
    tail = (data & 0xC0) == 0x80
    at = np.flatnonzero(data[3:-1] == 32) + 3
    a, b, c, after = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
    before = ((a > 32) & (a < 127)) | (tail[at - 1] & (b >= 0xC3) & (b <= 0xDF)) | (tail[at - 1] & tail[at - 2] & (c >= 0xE4) & (c <= 0xED))
    follows = ((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xDF)) | ((after >= 0xE4) & (after <= 0xED))
    spaces = at[before & follows]
    lead = np.flatnonzero((data[3:-2] == 0xE3) | (data[3:-2] == 0xEF)) + 3
    stop = STOPS[(data[lead] == 0xEF).astype(int), data[lead + 1], data[lead + 2]]
    first, second = data[lead - 3], data[lead - 2]
    letter = ((first >= 0xE5) & (first <= 0xE8)) | ((first == 0xE9) & (second != 0xBF)) | ((first == 0xE3) & (second == 0x81) & (data[lead - 1] != 0x80))
    return np.sort(np.concatenate([spaces, lead[stop & letter]]))


class ChunkEncoder:
    """Encodes and decodes texts exactly as the tokenizer does on whole texts.

    A rolling hash over the last WINDOW bytes chooses the places to cut, so equal passages are cut alike wherever they
    stand; each distinct chunk is encoded once and kept. A cut is moved to a safe place nearby. Where there is none
    (a chunk of over max_chunk bytes without one), the cut is made anyway and the join repaired: the stretch around it
    is encoded anew and widened on both sides until it ends at safe cuts or text ends, where tokens must agree.
    """

    WINDOW, MASK = 16, 31

    def __init__(self, path: str, max_kept: int = 40_000, max_chunk: int = 65_536):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_kept, self.max_chunk = max_kept, max_chunk
        self.merges = RankedMerges(path, PATTERN) if self._plain_setup() else None
        self.chunks: dict[bytes, bytes] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        alphabet = byte_alphabet()
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = [bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p in pieces]
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[i] = t.content.encode()
        self.name_of = [str(i) for i in range(size)]

    def _plain_setup(self) -> bool:
        """Whether the tokenizer is byte-level BPE with PATTERN and nothing else, so that the rank table may stand in."""
        import json

        t = json.loads(self.tokenizer.to_str())
        pre, model = t["pre_tokenizer"] or {}, t["model"]
        plain = not (t["normalizer"] or model["dropout"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model["ignore_merges"])
        return plain and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """Safe places in the bytes that the rolling hash chooses."""
        n = len(data)
        if n <= self.WINDOW:
            return np.empty(0, np.int64)
        h, span = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B), 1
        power = np.uint32(0x01000193)
        while span < self.WINDOW:
            wider = h.copy()
            wider[span:] += h[:-span] * power
            h, span, power = wider, span * 2, np.uint32(int(power) ** 2 % (1 << 32))
        at = safe_places(data)
        at = at[at >= self.WINDOW]
        x = h[at - 1]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return at[((x >> np.uint32(12)) & np.uint32(self.MASK)) == 0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        pieces: list[list[bytes] | None] = []
        forced: list[bool] = []
        for text in texts:
            if any(s in text for s in self.special):
                pieces.append(None)
                forced.append(False)
                continue
            raw = text.encode()
            ends = [*self.boundaries(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
            cut, at, hard = [], 0, False
            for end in ends:
                while end - at > self.max_chunk:
                    stop = at + self.max_chunk
                    while raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    cut.append(raw[at:stop])
                    at, hard = stop, True
                if end > at:
                    cut.append(raw[at:end])
                    at = end
            pieces.append(cut)
            forced.append(hard)
        self._learn({c for cut in pieces if cut for c in cut})
        out = []
        for text, cut, hard in zip(texts, pieces, forced, strict=True):
            if cut is None:
                out.append(le32(self.tokenizer.encode(text, add_special_tokens=False).ids))
            elif hard:
                out.append(self._joined(cut))
            else:
                out.append(b"".join(map(self.chunks.__getitem__, cut)))
        return out

    def _learn(self, wanted: set[bytes]) -> None:
        fresh = {c for c in wanted if c not in self.chunks}
        if len(self.chunks) + len(fresh) > self.max_kept:
            self.chunks.clear()
            fresh = wanted
        quick, ranks = [], []
        for chunk in fresh:
            text = chunk.decode()
            if self.merges and max(text) < PLAIN_BELOW:
                quick.append(chunk)
                ranks.append(self.merges.core.encode_ordinary(text))
            else:
                self.chunks[chunk] = le32(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if quick:
            self.chunks.update(zip(quick, self.merges.gathered(ranks), strict=True))

    def _joined(self, cut: list[bytes]) -> bytes:
        """The ids of chunks in a row of which some joins aren't at safe places."""
        done, left = [], ""  # left: text whose ids aren't final yet, from a safe cut on
        for i, chunk in enumerate(cut):
            text = left + chunk.decode(errors="strict")
            if i + 1 == len(cut):
                done.append(le32(self.tokenizer.encode(text, add_special_tokens=False).ids))
                break
            last = None
            for last in SAFE_CUT.finditer(text):
                pass
            if last is None:
                left = text  # no place where tokens must agree: widen into the next chunk
                continue
            at = last.start()
            done.append(le32(self.tokenizer.encode(text[:at], add_special_tokens=False).ids))
            left = text[at:]
        return b"".join(done)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def _rows(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id and ids (array of int), the tokenizer's ids of the whole text.

    Null texts count as empty and give no ids; ids of rows are independent, so repeated rows and null doc_ids need no
    rule. One pass without any shuffle; chunks are shared by all documents that a Python worker meets.
    """
    d = _rows(docs, text_col, id_col)
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>"

    def run(batches):
        for batch in slices(batches, 1):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoder(tokenizer_path).encode_all(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return d.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of each row of ids, special tokens written out; null ids count as none."""
    d = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches):
        for batch in batches:
            texts = [encoder(tokenizer_path).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: bpe_encode and bpe_decode of each text, reduced to digests where they are made."""
    d = _rows(docs, text_col, id_col)
    schema = StructType([d.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    target = arrow_schema(schema)

    def run(batches):
        for batch in slices(batches, 1):
            e = encoder(tokenizer_path)
            counts, of_ids, of_text = [], [], []
            for data in e.encode_all(batch.column(1).to_pylist()):
                ids = np.frombuffer(data, "<u4").tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(e.name_of.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield as_batch({"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}, target)

    return d.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), default_vocabulary("byte_bpe_50k.json"))

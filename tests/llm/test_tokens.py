import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tests.llm.cases import awkward, documents
from tokenizers import Tokenizer

from tarnlake.llm.bpe import ChunkEncoder, bpe_decode, bpe_digests, bpe_encode
from tarnlake.llm.packing import first_fit_decreasing, pack

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_the_library(spark, sf_small):
    t = plain(BYTE)
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(docs, BYTE).collect())
        want = []
        for r in docs.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            text = t.decode(ids, skip_special_tokens=False)
            want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want)


def test_bpe_round_trip_and_empty(spark):
    docs = documents(spark)
    back = bpe_decode(bpe_encode(docs, BYTE), BYTE)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert bpe_digests(documents(spark, []), BYTE).count() == 0


def test_joins_without_safe_cut_are_repaired():
    e, t = ChunkEncoder(BYTE, max_chunk=64), plain(BYTE)
    for text in ("abcdefgh" * 200, "añ\n\n  ñ" * 100, "x " * 300, "don't stop 12345678 " * 30 + "é" * 300, " " * 500 + "a"):
        assert np.frombuffer(e.encode_all([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_cuts_in_other_scripts():
    """Chunks begin where tokens begin in any script, and passages are shared there too."""
    rng = np.random.default_rng(7)
    e, t = ChunkEncoder(BYTE), plain(BYTE)
    cjk = [chr(c) for c in [*range(0x5000, 0x5100), *range(0x3041, 0x3060)]]
    cyrillic = [chr(c) for c in range(0x430, 0x450)]
    def prose(letters, space):
        return "".join("".join(rng.choice(letters, rng.integers(2, 9))) + str(rng.choice(space)) for _ in range(1500))
    passages = [prose(cjk, ["。", "、", "，", "？", " ", ""]), prose(cyrillic, [" ", " ", ", ", ". ", "\n"])]
    odd = ["\u3000", "\u00a0", "\u2003", "\u0085", " ", "  ", "。", "、", "！", "'s", "é", "字", "あ", "゙", "〇", "䷀", "Ж", "a", "1", "·", "\u1680", "龿", "\u3040", "\u0301"]
    texts = passages + ["".join(rng.choice(odd, rng.integers(1, 60))) for _ in range(3000)] + ["x" * 9 + "".join(rng.choice(odd, 300)) for _ in range(50)]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode_all(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    for text in passages:
        own = ChunkEncoder(BYTE)
        own.encode_all([text])
        before = len(own.chunks)
        assert before > 10
        own.encode_all([f"前 Вот {text} end"])
        assert len(own.chunks) <= before + 4  # all but the ends are known


def test_cache_is_emptied_when_full():
    e, t = ChunkEncoder(BYTE, max_kept=50), plain(BYTE)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    assert [np.frombuffer(b, "<u4").tolist() for text in texts for b in e.encode_all([text])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_first_fit_decreasing():
    sizes = [7, 3, 5, 5, 2, 8, 1, 9, 10]
    bins, room = {}, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if at == len(room):
            room.append(10)
        room[at] -= sizes[i]
        bins[i] = at
    assert first_fit_decreasing(sizes, 10) == [bins[i] for i in range(len(sizes))]
    assert first_fit_decreasing([], 10) == []


def test_packing(spark, sf_small):
    t = plain(WORD)
    for docs in (awkward(documents(spark)), spark.read.parquet(f"{sf_small}/documents.parquet")):
        rows = pack(docs, WORD).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append((r.offset, r.length))
        want = defaultdict(list)
        for r in docs.collect():
            want[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 1])
        assert pieces.keys() == want.keys()
        for k, lists in want.items():
            expected = sorted((s, min(2048, len(x) - s), zlib.crc32(np.asarray(x[s : s + 2048], "<u4").tobytes()), len(x)) for x in lists for s in range(0, len(x), 2048))
            assert expected == sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[k])
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert sum(r.length for r in rows) > 0.5 * 2048 * len(sequences)
    assert pack(documents(spark, []), WORD).count() == 0

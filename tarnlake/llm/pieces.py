"""Token ids of short strings, as the tokenizers library gives them, several times faster."""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

#: Texts below this character are split and lower-cased alike by every library: Latin letters, all in composed form.
PLAIN_BELOW = "ɐ"


def le32(ids) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return np.asarray(ids, "<u4").tobytes()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankedMerges:
    """The merges of a tokenizers file as a rank table, in which a pair's rank is that of the string it makes.

    This gives the library's ids because only strings are in it that the library itself makes one token of: whenever
    two tokens x and y that make such a string t stand side by side, they came about by merges inside t alone, in the
    order in which t by itself is merged, so they are the very pair that the library merges to t. Strings of the
    vocabulary that the library never makes a token of are left out. The end-of-word mark becomes the byte 0xFF, which
    no UTF-8 text has; it joins the byte before it first of all.
    """

    END = b"\xff"

    def __init__(self, path: str, pattern: str):
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, mark, alphabet = model["vocab"], model["end_of_word_suffix"] or "", byte_alphabet()
        self.end = self.END if mark else b""

        def raw(token: str) -> bytes:
            ends = bool(mark) and token.endswith(mark)
            return bytes(alphabet[c] for c in (token[: -len(mark)] if ends else token)) + self.END * ends

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if len({x + y for x, y in pairs}) != len(pairs):
            raise ValueError("a string is made by two merges")
        rank_of = {p: i for i, p in enumerate(pairs)}
        singles = [c + m for m in ([mark, ""] if mark else [""]) for c in alphabet]
        ranked = [s for s in singles if s in vocab] + [x + y for x, y in pairs if self._whole(rank_of, x + y, mark)]
        ranks = {raw(t): i for i, t in enumerate(ranked)}
        for b in range(256):  # every byte must have a rank; those without a token of their own never stay alone
            ranks.setdefault(bytes([b]), len(ranks))
        self.ids = np.zeros(len(ranks), np.uint32)
        for t, i in zip(ranked, range(len(ranked)), strict=True):
            self.ids[i] = vocab[t]
        self.core = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _whole(rank_of: dict[tuple[str, str], int], token: str, mark: str) -> bool:
        """Whether merging the token's own characters by rank ends with the whole token."""
        if mark and token.endswith(mark):
            parts = [*token[: -len(mark)]]
            parts[-1] += mark
        else:
            parts = [*token]
        while len(parts) > 1:
            rank, at = min((rank_of.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def gathered(self, rank_lists: list[list[int]]) -> list[bytes]:
        """Ids of each list of ranks, as le32."""
        data = self.ids[np.fromiter(chain.from_iterable(rank_lists), np.int64)].astype("<u4").tobytes()
        ends = (4 * np.cumsum([0, *map(len, rank_lists)])).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

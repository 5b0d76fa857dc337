"""Words and hashes of whole Arrow batches of texts, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_CHUNK = 1 << 20  # bytes hashed at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x + _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and len + 1 offsets; the column has no nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of the text of each word, a longest run of other bytes than ASCII white space in one text."""
    full = ~_SPACES[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    some = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][some], offsets[1:][some] - 1
    first[begin] = full[begin]
    last[end] = full[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes; another seed gives an independent one."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1)) | np.uint64(1)
    table[_SPACES] = 0
    base = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + _CHUNK)))
        s, high = starts[at:to] - low, ends[to - 1]
        gaps = np.diff(np.append(s, high - low))
        place = np.arange(high - low) - np.repeat(s, gaps)
        value = table[data[low:high]]
        # white space after a word is zero, so its place doesn't matter
        value *= _powers(int(gaps.max()), base)[place]
        out[at:to] = np.add.reduceat(value, s)
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `width` values in a row; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(int(mix(np.array([seed + 31], np.uint64))[0]) | 1)
    out = h[:n].copy()
    for j in range(1, width):
        out *= base
        out += h[j : n + j]
    return mix(out)


def range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the values from each start to before each end, by prefix sums."""
    base = int(mix(np.array([seed + 53], np.uint64))[0]) | 1
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h), base), dtype=np.uint64)])
    inverse = _powers(len(h) + 1, pow(base, -1, 1 << 64))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest of each `width` values in a row."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = low[:-step], low[step:]
        at = np.where(left <= right, at[:-step], at[step:])
        low = np.minimum(left, right)
        span += step
    return at


class Bits:
    """A set of 64-bit hashes kept as bits: finds all that are in it, and a few that aren't. At most 2^MOST bits (16 MB)
    however many are put in; an overfull one finds more, which costs work and never changes a result."""

    LEAST, MOST = 10, 27

    def __init__(self, size: int):
        self.bits = np.zeros(1 << (size - 6), np.uint64)
        self.mask = np.uint64((1 << size) - 1)

    @classmethod
    def collected(cls, df, hash_col: str, count: int) -> "Bits":
        """Of the column's values; tasks join bits by word, so the driver gets 2^MOST / 64 words at most."""
        from pyspark.sql import functions as F

        out = cls(min(cls.MOST, max(cls.LEAST, (16 * count).bit_length())))
        place = F.col(hash_col).bitwiseAND(F.lit(int(out.mask)))
        word = F.shiftright(place, 6).alias("word")
        bit = F.expr(f"shiftleft(1L, cast(`{hash_col}` & 63 as int))").alias("bit")
        found = df.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        if found.num_rows:
            out.bits[found.column("word").to_numpy()] = found.column("bit").to_numpy().astype(np.int64).view(np.uint64)
        return out

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h & self.mask
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

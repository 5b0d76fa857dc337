"""SQL functions, and models that users plug in: embedder, tokenizer, generator."""

from __future__ import annotations

import asyncio
import contextlib
import hashlib
import inspect
import threading
import time
from collections import OrderedDict
from collections.abc import Awaitable, Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of texts that are Python's at once.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 1000


def register_sql(spark: SparkSession) -> None:
    """clean_text, is_noisy, split_sentences and cosine_similarity for spark.sql(), as SQL functions that Catalyst inlines."""
    from tarnlake.functions.text import CLEANING

    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    body = "coalesce(text, '')"
    for pattern, new in CLEANING:
        body = f"regexp_replace({body}, {quoted(pattern)}, {quoted(new)})"
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} clean_text(text STRING) RETURNS STRING RETURN trim({body})")
    count = "size(filter(split(text, '(?U)\\\\s+'), w -> w <> ''))"
    spark.sql(f"{make} is_noisy(text STRING) RETURNS BOOLEAN RETURN {count} < 10 OR (length(text) - length(replace(text, '|', ''))) / ({count} + 1) > 0.3 OR (contains(text, 'Wikipedia') AND NOT contains(text, '://'))")
    spark.sql(f"{make} split_sentences(text STRING) RETURNS ARRAY<STRING> RETURN filter(split(trim(regexp_replace(text, '(?U)\\\\s+', ' ')), '(?<=[.!?…])\\\\s+'), s -> length(s) > 3)")
    product = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    spark.sql(f"{make} cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {product('a', 'b')} / nullif(sqrt({product('a', 'a')}) * sqrt({product('b', 'b')}), 0D)")


def hash_vector(text: str, size: int) -> list[float]:
    """Stands in for a model: a bag of hashed words, of length one. Equal texts have equal vectors, wherever computed."""
    out = np.zeros(size)
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % size] += 1.0 if h >> 63 else -1.0
    length = np.linalg.norm(out)
    return (out / length if length else out).astype(np.float32).tolist()


def sentence_encoder(size: int = 768) -> Callable[[list[str]], np.ndarray]:
    """hash_vector of many texts at once, a row each; words met before aren't hashed again."""

    class Places(dict):
        """Of each word its cell, made negative by its sign: -1 - cell."""

        def __missing__(self, word: str) -> int:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = found = h % size if h >> 63 else -1 - h % size
            return found

    place = Places().__getitem__

    def encode(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        cells = np.fromiter(map(place, chain.from_iterable(words)), np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        away = cells < 0
        out = np.bincount(rows * size + np.where(away, -1 - cells, cells), np.where(away, -1.0, 1.0), len(texts) * size).reshape(len(texts), size)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).astype(np.float32)

    return encode


class TimedCache:
    """Values by key, at most `size` of them and none older than `seconds`; the least recently used one goes first. The
    clock is a parameter, so that a run may be repeated."""

    def __init__(self, size: int = 500, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self._held: OrderedDict = OrderedDict()

    def get(self, key, default=None):
        held = self._held.get(key)
        if held is None:
            return default
        if self.clock() - held[1] > self.seconds:
            del self._held[key]
            return default
        self._held.move_to_end(key)
        return held[0]

    def put(self, key, value) -> None:
        self._held[key] = (value, self.clock())
        self._held.move_to_end(key)
        if len(self._held) > self.size:
            self._held.popitem(last=False)

    def __len__(self) -> int:
        now = self.clock()
        for key in [k for k, (_, at) in self._held.items() if now - at > self.seconds]:
            del self._held[key]
        return len(self._held)


def cached(model: Callable[[list[str]], list], cache: TimedCache) -> Callable[[list[str]], list]:
    """The model, asked only for texts that the cache hasn't, each once."""

    def run(texts: list[str]) -> list:
        found = {t: cache.get(t) for t in dict.fromkeys(texts)}
        missing = [t for t, v in found.items() if v is None]
        for t, v in zip(missing, model(missing) if missing else [], strict=True):
            found[t] = v
            cache.put(t, v)
        return [found[t] for t in texts]

    return run


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[list[str]]:
    """The texts in order, null as empty, as lists of texts with `most` bytes or a thousand rows at most, or of one text: an Arrow
    batch has a number of rows, whatever their size, and only one list of it is made Python's at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (held + size > most or i - begin == PIECE_ROWS):
            yield pc.fill_null(texts.slice(begin, i - begin), "").to_pylist()
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield pc.fill_null(texts.slice(begin), "").to_pylist()


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, size: int = 768) -> Callable[[Column], Column]:
    """A column function text -> array<float>. load() is called once in each task and gives a function of a list of
    texts, which gets texts of the task's last 500 distinct ones (TimedCache's size and age) once; without it, hash_vector.
    The model gets `pieces` of a batch, and vectors are kept as Arrow's floats."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = cached(load() if load else lambda texts: [hash_vector(t, size) for t in texts], TimedCache())
        for batch in batches:
            found = [pa.array(model(texts), pa.list_(pa.float32())) for texts in pieces(batch)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float32()))

    return embed


def generator(load: Callable[[], Callable[[str], str]] | None, apology: str) -> Callable[[Column], Column]:
    """A column function prompt -> answer; any error, and no model, gives the apology."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else None

        def one(prompt):
            try:
                return model(prompt) if model else apology
            except Exception:  # a service that fails must not fail the job
                return apology

        for batch in batches:
            yield batch.map(one)

    return generate


async def _in_thread(call: Callable[[str], str], prompt: str) -> str:
    """A call that blocks, in a thread of its own: one that never ends holds up neither the others nor the worker's end."""
    loop = asyncio.get_running_loop()
    answer = loop.create_future()

    def settle(set_, value) -> None:
        if not answer.done():
            set_(value)

    def run() -> None:
        try:
            done = (answer.set_result, call(prompt))
        except Exception as e:
            done = (answer.set_exception, e)
        with contextlib.suppress(RuntimeError):  # the loop may be closed by then
            loop.call_soon_threadsafe(settle, *done)

    threading.Thread(target=run, daemon=True).start()
    return await answer


async def answered(model: Callable[[str], str] | Callable[[str], Awaitable[str]], prompts: list[str | None], apology: str, concurrent: int, call_seconds: float, row_seconds: float, retries: int) -> list[tuple[str, str | None, int]]:
    """Answer, error (none: it went well) and number of calls of each prompt, `concurrent` of them at work at a time."""
    gate, loop = asyncio.Semaphore(concurrent), asyncio.get_running_loop()
    blocks = not inspect.iscoroutinefunction(model) and not inspect.iscoroutinefunction(getattr(model, "__call__", None))

    async def one(prompt: str | None) -> tuple[str, str | None, int]:
        if prompt is None:
            return apology, "no prompt", 0
        async with gate:
            end, error, calls = loop.time() + row_seconds, "", 0
            for _ in range(1 + retries):
                left = min(call_seconds, end - loop.time())
                if left <= 0:
                    return apology, f"out of time: {error}", calls
                calls += 1
                try:
                    return await asyncio.wait_for(_in_thread(model, prompt) if blocks else model(prompt), left), None, calls
                except TimeoutError:
                    error = "timed out"
                except Exception as e:  # a service that fails must not fail the job
                    error = f"{type(e).__name__}: {e}"
            return apology, error, calls

    return await asyncio.gather(*map(one, prompts))


def concurrent_generator(load: Callable[[], Callable], apology: str, concurrent: int = 8, call_seconds: float = 45.0, row_seconds: float = 120.0, retries: int = 2) -> Callable[[Column], Column]:
    """A column function prompt -> struct<answer, error, calls>. load() is called once a task and gives a function, plain or asynchronous,
    of a prompt. A task has up to `concurrent` calls under way at a time; a call has call_seconds, all tries of a row row_seconds. Where
    none succeeds the answer is the apology, and error says why; equal prompts of a batch are asked once."""

    @F.pandas_udf("answer string, error string, calls int")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            prompts = [None if p is None or p != p else p for p in batch]
            asked = list(dict.fromkeys(prompts))
            got = dict(zip(asked, asyncio.run(answered(model, asked, apology, concurrent, call_seconds, row_seconds, retries)), strict=True))
            yield pd.DataFrame([got[p] for p in prompts], columns=["answer", "error", "calls"])

    return generate

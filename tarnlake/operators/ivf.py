"""Approximate nearest neighbours: an inverted file of k-means cells with product-quantised residuals, re-ranked exactly."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from tarnlake.errors import InvalidArgument
from tarnlake.functions.vectors import cosine
from tarnlake.operators.relational import last_n

#: Rows of a cell, and queries that look into it, which meet in one step.
BLOCK_POINTS, BLOCK_QUERIES = 8192, 512
#: Blocks of queries that meet a block of points in one step where all cells are looked into, and pairs scored at once.
QUERY_BLOCKS, PAIRS = 4, 1 << 16
#: More than what rounding can add to a cosine, in double and in single precision.
ROUNDING, SINGLE = 1e-9, 1e-4


@dataclass
class Quantiser:
    """centers: a row per cell, of length one; books: of each part of `width` dimensions the codewords of residuals."""

    centers: np.ndarray
    books: np.ndarray

    @property
    def size(self) -> int:
        return self.centers.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts, filled up with zeros: rows x parts x width."""
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cell = (x @ self.centers.T).argmax(axis=1)
        rest = self.parts(x - self.centers[cell])
        codes = [nearest(rest[:, j], self.books[j]) for j in range(len(self.books))]
        return cell, np.stack(codes, axis=1).astype(np.uint8) if codes else np.empty((len(x), 0), np.uint8)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        rest = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        return self.centers[cell] + rest[:, : self.size]

    def looked_up(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines, queries x rows of one cell: tables of a query's products with all codewords, added up by code."""
        tables = np.einsum("qmw,mcw->mqc", self.parts(queries), self.books)
        out = np.repeat((queries @ self.centers[cell])[:, None], len(codes), axis=1)
        for j, table in enumerate(tables):
            out += table[:, codes[:, j]]
        return out


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool = False) -> np.ndarray:
    """Lloyd's method from k different rows; a cell that loses all its rows keeps its center."""
    rows = np.unique(x, axis=0)
    centers = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        cell = (x @ centers.T).argmax(axis=1) if unit else nearest(x, centers)
        n = np.bincount(cell, minlength=len(centers))
        total = np.stack([np.bincount(cell, column, len(centers)) for column in x.T], axis=1)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
        if unit:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def unit_vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with `size` dimensions and a length, as unit vectors, and their numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    if not column.null_count and not values.null_count and np.all(np.diff(column.offsets.to_numpy()) == size):
        fits, x = range(len(column)), values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)
        return _of_length_one(x, fits)
    rows = column.to_pylist()
    fits = [i for i, v in enumerate(rows) if v is not None and len(v) == size and None not in v]
    return _of_length_one(np.array([rows[i] for i in fits], float).reshape(len(fits), size), fits)


def _of_length_one(x: np.ndarray, fits: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.linalg.norm(x, axis=1)
    some = np.isfinite(lengths) & (lengths > 0)
    return x[some] / lengths[some, None], np.array([*fits], np.int64)[some]


def fit(points: DataFrame, id_col: str = "id", vector: str = "embedding", cells: int | None = None, sample_rows: int = 16_384, width: int = 2, words: int = 256, rounds: int = 12, seed: int = 7) -> Quantiser:
    """Cells and codewords, from the sample_rows points with the smallest hashes of their ids (the only bound; every point is
    put in a cell by `index`). `cells` is the square root of the number of points unless given, and at most a sixteenth of the sample."""
    sample = points.filter(F.col(vector).isNotNull()).select(id_col, vector).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).toArrow()
    sizes = [len(v) for v in sample[vector].to_pylist()]
    if not sizes:
        raise InvalidArgument("NO_POINTS", "there is no vector to fit cells to")
    x, _ = unit_vectors(sample[vector].combine_chunks() if sample.num_rows else sample[vector], max(set(sizes), key=sizes.count))
    cells = cells or round(points.count() ** 0.5)
    centers = k_means(x, max(1, min(cells, sample_rows // 16, len(x))), rounds, seed, unit=True)
    m = -(-x.shape[1] // width)
    out = Quantiser(centers, np.zeros((m, 1, width)))
    rest = out.parts(x - centers[(x @ centers.T).argmax(axis=1)])
    books = [k_means(rest[:, j], words, rounds, seed + j) for j in range(m)]
    most = max(len(b) for b in books)
    out.books = np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books])
    return out


def index(points: DataFrame, quantiser: Quantiser, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """points with `cell` and `code` (a byte a part) in place of the vector; a table to be stored and read many times. Points
    without a vector, of another size or of length zero have neither, and are never found."""
    shared = points.sparkSession.sparkContext.broadcast(quantiser)
    rest = [c for c in points.columns if c != vector]
    rows = points.select(*rest, vector)
    schema = StructType([*(points.schema[c] for c in rest), StructField("cell", IntegerType()), StructField("code", BinaryType())])
    target = to_arrow_schema(schema)

    def run(batches):
        q = shared.value
        for batch in batches:
            x, at = unit_vectors(batch.column(len(rest)), q.size)
            cell, code = np.full(batch.num_rows, -1), [None] * batch.num_rows
            if len(x):
                cell[at], codes = q.encode(x)
                for i, c in zip(at.tolist(), codes, strict=True):
                    code[i] = c.tobytes()
            own = [batch.column(i).cast(target.field(i).type) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cell, pa.int32(), mask=cell < 0), pa.array(code, pa.binary())], schema=target)

    return rows.mapInArrow(run, schema)


def probes(queries: DataFrame, quantiser: Quantiser, count: int, vector: str = "embedding") -> DataFrame:
    """query, v (the unit vector) and cell: of each query the `count` cells with the nearest centers."""
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)
    kind = queries.schema["query"]

    def run(batches):
        q = shared.value
        for batch in batches:
            x, at = unit_vectors(batch.column(1), q.size)
            cells = np.argsort(-(x @ q.centers.T), axis=1, kind="stable")[:, :count].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int32()))], ["query", "v", "cells"])

    rows = queries.select("query", vector).mapInArrow(run, f"query {kind.dataType.simpleString()}, v array<double>, cells array<int>")
    return rows.select("query", "v", F.explode("cells").alias("cell"))


def candidates(indexed: DataFrame, asked: DataFrame, quantiser: Quantiser, rerank: int, id_col: str = "id", collection: str | None = None) -> DataFrame:
    """query, id_col (and collection): of each query (asked: query, v, cell) the `rerank` points of its cells (and of each
    collection) with the highest looked-up cosines.

    Points and queries meet by their cell. A cell is cut into blocks of BLOCK_POINTS points and BLOCK_QUERIES queries, by
    counts of both (a row per cell, of which there are few), so that no cell is one task's however large it is; each
    block hands on its best alone.
    """
    by = [collection] if collection else []
    points = indexed.filter("cell is not null").select(F.col(id_col).alias("_id"), *[F.col(c).alias("_c") for c in by], "cell", "code")
    # at most as many rows as there are cells, which fit bounds
    counts = points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("_p")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_q")), "cell")
    counts = F.broadcast(counts)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = points.join(counts, "cell").withColumns({"pb": F.pmod(F.xxhash64("_id"), F.col("_p")).cast("int"), "qb": spread("_q")}).drop("_p", "_q")
    asked = asked.join(counts, "cell").withColumns({"qb": F.pmod(F.xxhash64("query"), F.col("_q")).cast("int"), "pb": spread("_p")}).drop("_p", "_q")
    schema = StructType([asked.schema["query"], points.schema["_id"], *(points.schema["_c"] for _ in by), StructField("near", DoubleType())])
    target = to_arrow_schema(schema)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        left = left.sort_by("_id")
        queries = np.array(right["v"].to_pylist())
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        near = quantiser.looked_up(queries, left["cell"][0].as_py(), codes)
        groups = [np.arange(left.num_rows)]
        if by:
            kinds = left["_c"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            groups = [np.flatnonzero(kinds == k) for k in np.unique(kinds)]
        rows, columns = [], []
        for own in groups:
            best = own[np.argsort(-near[:, own], axis=1, kind="stable")[:, :rerank]]  # of equal ones the lower id first
            rows.append(np.repeat(np.arange(len(queries)), best.shape[1]))
            columns.append(best.ravel())
        r, c = np.concatenate(rows), np.concatenate(columns)
        out = [right["query"].take(pa.array(r)), left["_id"].take(pa.array(c)), *([left["_c"].take(pa.array(c))] if by else []), pa.array(near[r, c])]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], schema=target)

    found = points.groupBy("cell", "pb", "qb").cogroup(asked.groupBy("cell", "pb", "qb")).applyInArrow(meet, schema)
    found = last_n(found, ["query", *("_c" for _ in by)], [F.desc("near"), F.col("_id")], rerank, "_r")
    return found.select("query", F.col("_id").alias(id_col), *[F.col("_c").alias(c) for c in by])


def approximate_search(points: DataFrame, indexed: DataFrame, quantiser: Quantiser, queries: DataFrame, top_k: int = 5, threshold: float | None = None, share: float = 0.6, rerank: int = 50, id_col: str = "id", vector: str = "embedding", collection: str | None = None) -> DataFrame:
    """The top_k points of each query (query, vector), and of each collection if one is named, with score and rank.

    indexed is index(points, ...), filtered as the search is to be. `share` of the cells are looked into by code, nearest first, and the
    best `rerank` by code are scored exactly, by one join with their vectors: only those pairs meet whole vectors. With
    share 1 and rerank as many as there are points the result is exact; from a block's points on, `exact_by_code` gives it, as a
    list of all pairs would grow with their product. Scores below the threshold go.
    """
    if top_k <= 0:
        raise InvalidArgument("TOP_K", "top_k must be over 0")
    count = max(1, int(np.ceil(share * len(quantiser.centers))))
    if count >= len(quantiser.centers) and rerank >= BLOCK_POINTS:
        return exact_by_code(points, indexed, quantiser, queries, top_k, threshold, id_col, vector, collection)
    found = candidates(indexed, probes(queries, quantiser, count, vector), quantiser, max(rerank, top_k), id_col, collection)
    named = [F.col(c).alias("_col") for c in ([collection] if collection else [])]
    whole = points.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    asked = queries.select(F.col("query").alias("_query"), F.col(vector).alias("_w"))
    rows = found.select("query", F.col(id_col).alias("_own"), *named).distinct().join(whole, F.col("_own") == F.col("_id")).join(asked, F.col("query") == F.col("_query"))
    rows = rows.select("query", F.col("_id").alias(id_col), *[F.col("_col").alias(collection) for _ in named], cosine(F.col("_v"), F.col("_w")).alias("score"))
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    return last_n(rows, ["query", *([collection] if collection else [])], [F.desc("score"), F.col(id_col)], top_k, "rank")


def exact_by_code(points: DataFrame, indexed: DataFrame, quantiser: Quantiser, queries: DataFrame, top_k: int = 5, threshold: float | None = None, id_col: str = "id", vector: str = "embedding", collection: str | None = None) -> DataFrame:
    """approximate_search over all cells and all candidates: exact, and no pair of a query and a point ever is a row.

    Points go with their cells and codes, and with their vectors, as a row each block of queries. A cosine is no further from the
    looked-up one than the decoded vector is from the point's own, so codes tell which pairs of a block may be among the top_k
    of their query (and collection) and reach the threshold. Those are scored by their vectors, as functions.vectors.cosine does,
    and a block hands on its top_k alone: rows grow with queries times blocks, work with queries times points."""
    by = [collection] if collection else []
    first = F.min(F.struct("cell", "code")).alias("_s")
    places = indexed.filter("cell is not null").groupBy(F.col(id_col).alias("_id"), *[F.col(c).alias("_c") for c in by]).agg(first)
    whole = points.select(F.col(id_col).alias("_own"), F.col(vector).alias("v"))
    p = places.join(whole, F.col("_id") == F.col("_own")).select("_id", *["_c" for _ in by], "_s.cell", "_s.code", "v")
    q = queries.select("query", F.col(vector).alias("v")).filter("v is not null")
    pn, qn = max(1, -(-points.count() // BLOCK_POINTS)), max(1, -(-q.count() // (QUERY_BLOCKS * BLOCK_QUERIES)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.withColumns({"pb": F.pmod(F.xxhash64("_id"), F.lit(pn)).cast("int"), "qb": spread(qn)})
    q = q.withColumns({"qb": F.pmod(F.xxhash64("query"), F.lit(qn)).cast("int"), "pb": spread(pn)})
    schema = StructType([q.schema["query"], p.schema["_id"], *(p.schema["_c"] for _ in by), StructField("score", DoubleType())])
    target = to_arrow_schema(schema)
    shared = points.sparkSession.sparkContext.broadcast(quantiser)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        known, left = shared.value, left.sort_by([*(("_c", "ascending") for _ in by), ("_id", "ascending")])
        (x, a), (y, b) = (unit_vectors(t["v"], known.size) for t in (left, right))
        if not len(a) or not len(b):
            return target.empty_table()
        left, right = left.take(pa.array(a)), right.take(pa.array(b))
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        coded = known.decoded(left["cell"].to_numpy(), codes)
        off = (np.linalg.norm(x - coded, axis=1) + SINGLE).astype(np.float32)
        own_x, own_y = (np.array(t["v"].combine_chunks().flatten(), float).reshape(t.num_rows, known.size) for t in (left, right))
        ends = [left.num_rows]
        if by:
            kinds = left["_c"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            ends = [*(np.flatnonzero(np.diff(kinds)) + 1).tolist(), *ends]
        rows, columns, scores = [], [], []
        coded = coded.astype(np.float32).T
        for at in range(0, len(y), BLOCK_QUERIES):
            some = slice(at, at + BLOCK_QUERIES)
            near = y[some].astype(np.float32) @ coded
            for begin, end in zip([0, *ends], ends):
                own = slice(begin, end)
                r, c, score = _best(near[:, own], off[own], x[own], y[some], own_x[own], own_y[some], top_k, threshold)
                rows.append(r + at)
                columns.append(c + begin)
                scores.append(score)
        r, c = np.concatenate(rows), np.concatenate(columns)
        out = [right["query"].take(pa.array(r)), left["_id"].take(pa.array(c)), *([left["_c"].take(pa.array(c))] if by else []), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays([z.combine_chunks() if isinstance(z, pa.ChunkedArray) else z for z in out], schema=target)

    found = p.groupBy("pb", "qb").cogroup(q.groupBy("pb", "qb")).applyInArrow(meet, schema)
    found = found.withColumnsRenamed({"_id": id_col} | {"_c": c for c in by})
    return last_n(found, ["query", *by], [F.desc("score"), F.col(id_col)], top_k, "rank")


def _best(near: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray, own_x: np.ndarray, own_y: np.ndarray, top_k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, point and score of the top_k points of each query, by cosines known to `off` (near: queries x points). Points are in
    the order of their ids. The nearest of each top_k-th part of the points are scored first: a point that can't be as near as
    the least of these is none of the top_k."""
    least = -np.inf if threshold is None else threshold
    floor = np.full(len(near), least - ROUNDING)
    if len(x) > top_k:
        parts = (near[:, i::top_k].argmax(axis=1) * top_k + i for i in range(top_k))
        floor = np.maximum(floor, np.min([np.einsum("ij,ij->i", y, x[p]) for p in parts], axis=0) - ROUNDING)
    r, c = np.nonzero(near + off >= floor[:, None].astype(np.float32))
    near = np.concatenate([np.einsum("ij,ij->i", y[r[i : i + PAIRS]], x[c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.empty(0)])
    kept = near >= floor[r]
    r, c, near = r[kept], c[kept], near[kept]
    kept = _top(r, near, top_k, ROUNDING)
    r, c = r[kept], c[kept]
    score = np.concatenate([cosines(own_y[r[i : i + PAIRS]], own_x[c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.empty(0)])
    r, c, score = (z[score >= least] for z in (r, c, score))
    order = np.lexsort((c, -score, r))
    r, c, score = r[order], c[order], score[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r) < top_k
    return r[kept], c[kept], score[kept]


def _top(group: np.ndarray, value: np.ndarray, k: int, within: float) -> np.ndarray:
    """Whether each value is no more than `within` below the k-th of its group; groups are in order."""
    order = np.lexsort((-value, group))
    first, last = np.searchsorted(group, group), np.searchsorted(group, group, "right")
    return value >= value[order[np.minimum(first + k, last) - 1]] - within


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, added up in the order of their dimensions as functions.vectors.cosine does, so that equal vectors have equal ones."""
    dot = lambda u, v: np.add.accumulate(u * v, axis=1)[:, -1]
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def exact_search(points: DataFrame, queries: DataFrame, top_k: int = 5, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The top_k points of each query (query, vector) by scoring every pair, with score and rank: points and queries are
    cut into blocks, each pair of which is one matrix product. Vectors that are null, of length zero or of another size
    than the first query's are never found."""
    p = points.select(F.col(id_col).alias("_id"), F.col(vector).alias("v")).filter("v is not null")
    q = queries.select("query", F.col(vector).alias("v")).filter("v is not null")
    first = q.select(F.size("v").alias("n")).first()
    pn, qn = max(1, -(-p.count() // BLOCK_POINTS)), max(1, -(-q.count() // BLOCK_QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = p.withColumns({"pb": F.pmod(F.xxhash64("_id"), F.lit(pn)).cast("int"), "qb": spread(qn)})
    q = q.withColumns({"qb": F.pmod(F.xxhash64("query"), F.lit(qn)).cast("int"), "pb": spread(pn)})
    schema = StructType([q.schema["query"], p.schema["_id"], StructField("score", DoubleType())])
    target, size = to_arrow_schema(schema), first.n if first else 0

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        left = left.sort_by("_id")
        (x, a), (y, b) = (unit_vectors(t["v"], size) for t in (left, right))
        score = y @ x.T
        best = np.argsort(-score, axis=1, kind="stable")[:, :top_k]
        rows = np.repeat(np.arange(len(y)), best.shape[1])
        out = [right["query"].take(pa.array(b[rows])), left["_id"].take(pa.array(a[best.ravel()])), pa.array(score[rows, best.ravel()])]
        return pa.Table.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], schema=target)

    found = p.groupBy("pb", "qb").cogroup(q.groupBy("pb", "qb")).applyInArrow(meet, schema)
    return last_n(found.withColumnRenamed("_id", id_col), ["query"], [F.desc("score"), F.col(id_col)], top_k, "rank")

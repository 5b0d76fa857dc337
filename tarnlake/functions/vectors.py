"""Vector arithmetic in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns; null if a length is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosines_to(a: Column, queries: list[list[float]]) -> Column:
    """An array of a vector's cosine to each of some constant vectors, all in one pass: a matrix product over a batch of
    rows. Its plan doesn't grow with the dimensions. Null where a length is zero or lengths differ."""
    q = np.array(queries, float).reshape(len(queries), -1)
    lengths = np.linalg.norm(q, axis=1)

    @F.pandas_udf(ArrayType(DoubleType()))
    def score(vectors: pd.Series) -> pd.Series:
        out = np.full((len(vectors), len(q)), np.nan)
        fits = np.flatnonzero([v is not None and len(v) == q.shape[1] for v in vectors])
        if len(fits):
            v = np.stack(vectors.to_numpy()[fits]).astype(float)
            both = np.linalg.norm(v, axis=1)[:, None] * lengths
            out[fits] = np.divide(v @ q.T, both, out=np.full(both.shape, np.nan), where=both > 0)
        return pd.Series([[None if x != x else x for x in row] for row in out.tolist()], dtype=object)

    return score(a)


def cosine_to(a: Column, query: list[float]) -> Column:
    """To one constant vector; null if a length is zero."""
    return F.get(cosines_to(a, [query]), 0)

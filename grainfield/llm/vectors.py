"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite numbers; never null."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of doubles from a list column without nulls; missing last components are 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten(), np.float64)
    n = np.asarray(vectors.value_lengths(), np.int64) if len(vectors) else np.zeros(0, np.int64)
    if (n == dim).all():
        return flat.reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out

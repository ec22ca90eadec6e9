"""What the operators on embeddings share: valid vectors as little-endian doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(embedding: Column) -> Column:
    """Not null, with components, none of them null, NaN or infinite, and not all zero."""
    x = F.coalesce(embedding.cast("array<double>"), F.array().cast("array<double>"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one width, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def rowwise_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows; the same vectors give the same bits wherever they stand."""
    return (a * b).sum(axis=1)

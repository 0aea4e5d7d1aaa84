"""Vector columns: which rows count, and how they become matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, dtype: type = np.float64) -> np.ndarray:
    """A list column without nulls as a matrix; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(sizes) * width == len(flat):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out

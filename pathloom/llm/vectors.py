"""Integer vectors: what is taken of a column of floating-point vectors, and how tasks read it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def matrix(column: pa.Array, dims: int, most: int) -> np.ndarray:
    """The rows of a list column as an int64 matrix; shorter rows end in zeros. Components beyond ``most`` would not give exact sums: an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, long = np.asarray(column.flatten(), np.int64), np.diff(np.asarray(column.offsets))
    if len(flat) and max(int(flat.max()), -int(flat.min())) > most:
        raise ValueError(f"a vector's component is beyond {most} after scaling")
    if (long == dims).all():
        return flat.reshape(len(long), dims)
    out = np.zeros((len(long), dims), np.int64)
    out[np.repeat(np.arange(len(long)), long), np.concatenate([np.arange(n) for n in long] or [np.empty(0, int)])] = flat
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(rows.ravel(), pa.int64()))

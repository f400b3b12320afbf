"""Rows that hold a usable vector, and their vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector_col: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    inf = F.lit(float("inf"))
    sound = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < inf, F.lit(False)) & ~F.isnan(c))
    return F.coalesce(sound, F.lit(False))


def width(vectors: DataFrame, vector_col: str) -> int:
    """Components of the longest vector, at least one; shorter ones count as if zeros followed."""
    return max(1, vectors.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()[0])


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A row of ``dims`` doubles for every vector of the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)  # more than one chunk is left only beyond 2 GB
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    if len(values) == len(column) * dims:
        return values.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def scaled_floor(values: np.ndarray, factor: int, most: int) -> np.ndarray:
    """``floor(factor * value)`` as whole numbers, at most ``most`` away from zero."""
    return np.clip(np.floor(values * factor), -float(most), float(most)).astype(np.int64)

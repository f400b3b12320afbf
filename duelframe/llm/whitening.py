"""Embedding whitening: covariance over distinct vectors, divided into components, applied to every row.

Three passes over the distinct vectors, which are written once: exact sums, centred products, and
products of the whitened vectors as a check. A task returns a number for every pair of dimensions,
however many rows it reads, and Spark adds them up. The matrix comes to the driver, where it is
divided (``spectral``); mean and components go out with the tasks. Both grow with the square of
the dimensions only, not with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.spectral import leading_eigenvectors
from duelframe.llm.vectors import is_finite, matrix, scaled_floor, width
from duelframe.session import materialize

SCALE, OFFSET = 64, 1_000_000
#: Whole numbers of components beyond this are set to it.
MOST = 1 << 48
COMPONENTS = 16
_LONG = 1 << 62


def whole(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return scaled_floor(matrix(column, dims), SCALE, MOST) + OFFSET


@dataclass
class Whitener:
    """Sums over ``n`` distinct vectors, eigenvalues falling, and their vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n``: whole steps from the mean's floor first, then its fraction."""
        floors = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rests = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - floors).astype(np.float64) - rests

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of ``(n*x - S)^2``; none where it does not fit a long."""
        sums = np.array(self.sums, dtype=object)
        far = float(np.abs(x).max(initial=0)) * self.n + float(max(map(abs, self.sums), default=0))
        if far < _LONG:
            gap = self.n * x - sums.astype(np.int64)
            if (gap.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < _LONG:
                return (gap**2).sum(axis=1).tolist()
        exact = [sum(int(g) ** 2 for g in row) for row in self.n * x.astype(object) - sums]
        return [v if v < 1 << 63 else None for v in exact]


def _summed_products(fit_list: DataFrame, dims: int, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of the products of every two columns of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = rows(matrix_of_longs(batch.column("x"), dims))
            total = own.T @ own if total is None else total + own.T @ own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    found = fit_list.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max((row["i"] for row in found), default=-1)
    out = np.zeros((size, size))
    for row in found:
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def matrix_of_longs(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def fit_list_of(usable: DataFrame, dims: int, vector_col: str) -> DataFrame:
    """Each distinct vector of whole numbers once, as the column ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(0), dims)
            ends = np.arange(len(x) + 1, dtype=np.int32) * dims
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel(), pa.int64()))], names=["x"])

    return usable.select(vector_col).mapInArrow(run, "x array<long>").distinct()


def fit(fit_list: DataFrame, dims: int, components: int = COMPONENTS) -> Whitener:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            x = matrix_of_longs(batch.column("x"), dims)
            n += len(x)
            total = total + x.sum(axis=0).astype(object)
        if n:
            columns = [pa.array([n] * dims, pa.int64()), pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "i", "total"])

    parts = fit_list.mapInArrow(add, "n long, i int, total string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    if not rows:
        return Whitener(0, [], np.zeros(0), np.zeros((dims, 0)), 0.0)
    sums = [int(row["total"]) for row in sorted(rows, key=lambda row: row["i"])]
    plain = Whitener(rows[0]["n"], sums, np.ones(0), np.zeros((dims, 0)), 0.0)
    covariance = _summed_products(fit_list, dims, plain.centred) / plain.n
    trace = float(np.trace(covariance))
    if not trace:
        return plain
    values, vectors = leading_eigenvectors(covariance, components)
    there = values > len(covariance) * np.finfo(float).eps * values[0]
    return Whitener(plain.n, sums, values[there], vectors[:, there], trace)


def identity_error(fit_list: DataFrame, dims: int, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on the list."""
    if not len(whitener.values):
        return 0.0
    covariance = _summed_products(fit_list, dims, whitener.whitened) / whitener.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: see the columns below.

    ``vec_id``, ``component`` (from 1, by falling eigenvalue, up to 16), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``. Rows whose vector is null or holds a null or
    non-finite component go. A shorter vector counts as if zeros followed; components are whole
    numbers of at most ``MOST``; a deviation beyond a long is null. Components without variance are left out: a
    table of equal vectors, or an empty one, gives no rows. Rows without an id, or with the same
    one, are rows of their own.
    """
    usable = vectors.filter(is_finite(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    dims = width(usable, "vector")
    fit_list = materialize(fit_list_of(usable, dims, "vector"), "fit-list")
    whitener = fit(fit_list, dims)
    count = len(whitener.values)
    error = identity_error(fit_list, dims, whitener)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            x = whole(batch.column("vector"), dims)
            row = np.repeat(np.arange(len(x)), count)
            deviation = pa.array(whitener.deviation(x), pa.int64()).take(pa.array(row))
            component = np.tile(np.arange(1, count + 1), len(x))
            columns = [batch.column("vec_id").take(pa.array(row)), pa.array(component, pa.int32()), deviation, pa.array(whitener.whitened(x).ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "deviation", "whitened"])

    shares = F.array(*[F.lit(float(v / whitener.trace)) for v in whitener.values]) if count else F.array(F.lit(0.0))
    return usable.mapInArrow(run, "vec_id long, component int, deviation long, whitened double").select(
        "vec_id",
        "component",
        F.lit(whitener.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )

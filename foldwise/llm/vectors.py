"""Vectors of an Arrow batch as one matrix, and the length that counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (rows, matrix)} of the lists that are neither null nor empty and hold finite numbers only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become NaN
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    out = {}
    for n in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == n))
        out[n] = rows, values[starts[rows, None] + np.arange(n)]
    return out


def of_length(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return by_length(column).get(n, (np.zeros(0, np.int64), np.zeros((0, n))))


def usual_length(lengths: DataFrame) -> int:
    """The length that most vectors have, from rows (d, n); of equally frequent ones the larger; 0 without any."""
    top = lengths.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def whole(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * value) as long, held between -limit and limit."""
    return np.clip(np.floor(scale * values), -limit, limit).astype(np.int64)

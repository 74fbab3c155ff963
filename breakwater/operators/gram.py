"""Correlations of all pairs of many columns in one scan.

A task keeps counts, means, squares and products of every pair over the rows that have both
values, block by block of its batches, about the batch's own means; two such blocks merge
without loss of digits. What leaves a task grows with the square of the columns, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a block; tasks whose blocks are merged together first.
BLOCK, TASKS = 64, 64
#: Rows that are multiplied at once.
ROWS = 4096
#: What is kept of a pair (a, b), over rows that have both: count, both means, both squares about them, product about them.
PARTS = ("n", "ma", "mb", "qa", "qb", "co")


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Parts of the rows of both."""
    n = x[0] + y[0]
    share = np.divide(y[0], n, out=np.zeros_like(n), where=n > 0)
    da, db, w = y[1] - x[1], y[2] - x[2], x[0] * share
    return np.stack([n, x[1] + da * share, x[2] + db * share, x[3] + y[3] + da * da * w, x[4] + y[4] + db * db * w, x[5] + y[5] + da * db * w])


def _of_rows(x: np.ndarray) -> np.ndarray:
    """Parts of all pairs of columns of a matrix, NaN where a value is missing."""
    there = ~np.isnan(x)
    shift = np.where(there, x, 0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
    v, m = np.where(there, x - shift, 0.0), there.astype(float)
    n, s = m.T @ m, v.T @ m
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    square = np.maximum((v * v).T @ m - s * mean, 0)
    return np.stack([n, mean + shift[:, None], (mean + shift[:, None]).T, square, square.T, v.T @ v - s * mean.T])


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pair_parts(rows: DataFrame, width: int) -> DataFrame:
    """``i, j, parts``: for each pair of blocks of places of the array ``x``, ``i <= j``, what is kept of their pairs, over all rows."""
    blocks = range(0, width, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(x), ROWS):
                new = _of_rows(x[at : at + ROWS])
                held = new if held is None else _merged(held, new)
        if held is not None:
            group = TaskContext.get().partitionId() // TASKS
            for i in blocks:
                for j in blocks:
                    if i <= j:
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([group], pa.int32()), pa.array([_bytes(held[:, i : i + BLOCK, j : j + BLOCK])], pa.binary())], ["i", "j", "g", "parts"])

    def merge(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        shape = (len(PARTS), min(BLOCK, width - i), min(BLOCK, width - j))
        held = None
        for one in table.column("parts"):
            x = np.frombuffer(one.as_py(), np.float64).reshape(shape)
            held = x if held is None else _merged(held, x)
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "parts": pa.array([_bytes(held)], pa.binary())})

    made = rows.mapInArrow(run, "i int, j int, g int, parts binary")
    near = made.groupBy("i", "j", "g").applyInArrow(merge, "i int, j int, parts binary")
    return near.groupBy("i", "j").applyInArrow(merge, "i int, j int, parts binary")


def correlations(wide: DataFrame, columns: list[str], array: Column | None = None) -> DataFrame:
    """``a, b, n, r`` of every pair of ``columns``, a before b: Pearson's correlation over the ``n`` rows that have both values.

    With ``array`` the values are those of an array column, of one length, and ``columns`` their names.

    ``r`` is null for fewer than two such rows or where a column is constant over them; NaN counts
    as missing. One scan of ``wide``; fewer than two columns or no rows give an empty result.
    """
    names, width = list(columns), len(columns)
    if width < 2:
        return wide.sparkSession.createDataFrame([], "a string, b string, n long, r double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, parts in zip(*(c.to_pylist() for c in batch.columns)):
                n, _, _, qa, qb, co = np.frombuffer(parts, np.float64).reshape(len(PARTS), min(BLOCK, width - i), min(BLOCK, width - j))
                a, b = np.nonzero((np.arange(i, i + n.shape[0])[:, None] < np.arange(j, j + n.shape[1])[None, :]))
                size = np.sqrt(qa[a, b]) * np.sqrt(qb[a, b])
                fine = (n[a, b] > 1) & (size > 0)
                r = np.divide(co[a, b], size, out=np.zeros(len(a)), where=fine)
                yield pa.RecordBatch.from_arrays([pa.array([names[i + k] for k in a], pa.string()), pa.array([names[j + k] for k in b], pa.string()), pa.array(n[a, b].astype(np.int64)), pa.array(np.clip(r, -1, 1), mask=~fine)], ["a", "b", "n", "r"])

    values = F.array(*[F.col(c).cast("double") for c in names]) if array is None else array
    return pair_parts(wide.select(values.alias("x")), width).mapInArrow(run, "a string, b string, n long, r double")

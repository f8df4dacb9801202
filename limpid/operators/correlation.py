"""Pairwise-complete correlation in one scan.

Every task keeps, for each pair of columns, the number of rows where both are present, the means
and squared deviations of either over those rows, and their co-deviation. A batch of rows adds
to all pairs at once by matrix products of values and presence masks. Such sums merge without
loss of accuracy, whatever the order, so the tasks' results are merged by pair in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limpid.operators.aggregate import small_table
from limpid.operators.schema import numeric_columns, ref

# Columns of one scan: six square matrices of doubles, some 50 MB at this width. Wider tables take
# a scan per pair of blocks.
BLOCK = 1024
# Partial results of one column that are merged in one first step.
SPREAD = 64
_PARTS = ("n", "mean_x", "mean_y", "dev_x", "dev_y", "co")
_SCHEMA = "i int, part int, " + ", ".join(f"{p} array<double>" for p in _PARTS)


def moments(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The six parts for all pairs of columns of two blocks of rows, NaN where missing.

    Values are taken relative to the first present one of their column, so a column that never
    varies has a deviation of exactly zero.
    """
    def shifted(a):
        there = ~np.isnan(a)
        base = np.where(there.any(0), a[there.argmax(0), np.arange(a.shape[1])], 0.0)
        return there.astype(float), np.where(there, a - base, 0.0), base

    (mx, vx, bx), (my, vy, by) = shifted(x), shifted(y)
    n = mx.T @ my
    some = np.maximum(n, 1)
    sum_x, sum_y = vx.T @ my, mx.T @ vy
    dev_x = np.maximum((vx * vx).T @ my - sum_x * sum_x / some, 0)
    dev_y = np.maximum(mx.T @ (vy * vy) - sum_y * sum_y / some, 0)
    co = vx.T @ vy - sum_x * sum_y / some
    return [n, np.where(n > 0, bx[:, None] + sum_x / some, 0), np.where(n > 0, by[None] + sum_y / some, 0), dev_x, dev_y, co]


def merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Parts of the union of two sets of rows."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * b[0] / some
    return [
        n, np.where(a[0] > 0, a[1] + dx * b[0] / some, b[1]), np.where(a[0] > 0, a[2] + dy * b[0] / some, b[2]),
        a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight,
    ]


def _partials(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    names = list(dict.fromkeys([*left, *right]))
    place = {c: i for i, c in enumerate(names)}
    at_left, at_right = [place[c] for c in left], [place[c] for c in right]
    cells = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            a[~np.isfinite(a)] = np.nan
            found = moments(a[:, at_left], a[:, at_right])
            total = found if total is None else merged(total, found)
        for i in range(len(at_left) if total is not None else 0):
            yield _row(i, 0, [p[i] for p in total])

    return cells.mapInArrow(run, _SCHEMA).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))


def _row(i: int, part: int, parts: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array([p.tolist()], pa.list_(pa.float64())) for p in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array([i], pa.int32()), pa.array([part], pa.int32()), *arrays], ["i", "part", *_PARTS]
    )


def _merge_rows(keys: tuple, rows: pa.Table) -> pa.Table:
    total = None
    for r in range(rows.num_rows):
        parts = [np.array(rows.column(p)[r].as_py()) for p in _PARTS]
        total = parts if total is None else merged(total, parts)
    part = keys[1].as_py() if len(keys) > 1 else 0
    return pa.Table.from_batches([_row(keys[0].as_py(), part, total)])


def co_moments(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """i and the six parts, each an array over `right`, for every column of `left`: one scan."""
    step = _partials(df, left, right).groupBy("i", "part").applyInArrow(_merge_rows, _SCHEMA)
    return step.groupBy("i").applyInArrow(_merge_rows, _SCHEMA)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pearson correlation of every pair, on the rows where both are present.

    Missing are nulls, NaN and infinities. A column's correlation with itself is 1; one that
    never varies on the shared rows, or shares fewer than two, has NULL.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    blocks = [columns[low : low + block] for low in range(0, len(columns), block)]
    rows = []
    for k, left in enumerate(blocks):
        for right in blocks[k:]:
            found = {r["i"]: r for r in co_moments(df, left, right).collect()}  # a row per column
            for i, a in enumerate(left):
                for j, b in enumerate(right):
                    if left is right and j < i:
                        continue
                    r = _pearson(found[i], j, a == b) if i in found else None
                    rows.append((a, b, r))
                    if a != b:
                        rows.append((b, a, r))
    return small_table(df.sparkSession, rows, "column_x string, column_y string, correlation double")


def _pearson(row, j: int, same: bool) -> float | None:
    n, x, y, co = row["n"][j], row["dev_x"][j], row["dev_y"][j], row["co"][j]
    if n < 2 or x <= 0 or y <= 0:
        return None
    return 1.0 if same else co / (x**0.5 * y**0.5)

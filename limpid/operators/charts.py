"""Data behind the charts: histograms, density curves, box plots, bars, points."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from limpid import constants as K
from limpid.operators.aggregate import collect_metrics, count_where, small_table
from limpid.operators.frequent import top_values_of
from limpid.operators.missing import complete_rows
from limpid.operators.outliers import is_outside
from limpid.operators.quantiles import quantiles
from limpid.operators.schema import numeric_columns, ref


def histogram(df: DataFrame, column: str, bins: int | None = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the present values; `bins=None` picks their number."""
    v = ref(column).cast("double")
    m = collect_metrics(df, {"lo": F.min(v), "hi": F.max(v), "n": F.count(v)})
    lo, hi, n = m["lo"], m["hi"], m["n"]
    schema = "bin long, lower double, upper double, n long"
    if not n:
        return small_table(df.sparkSession, [], schema)
    if bins is None:
        bins = _automatic_bins(df, column, lo, hi, n)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    # The last bin is closed on both sides, so the largest value belongs to it.
    index = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counted = df.filter(v.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counted, "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
            (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def _automatic_bins(df: DataFrame, column: str, lo: float, hi: float, n: int) -> int:
    """The narrower of the Sturges width and the Freedman-Diaconis width, the latter at least
    half the square-root width: 2 sqrt(n) bins at most, however far one value lies."""
    if lo == hi:
        return 1
    (q1, q3), = quantiles(df, [column], (0.25, 0.75), {column: n}).values()
    sturges = (hi - lo) / (math.log2(n) + 1)
    fd = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(sturges, max(fd, (hi - lo) / math.sqrt(n) / 2))
    return max(1, math.ceil((hi - lo) / width))


# Of the density: cells are half a kernel width wide, so a value lies at most a quarter from its
# cell's middle; the series has this many terms.
_CELL, _TERMS = 0.5, 12
# A cell further than this from a grid point, in kernel widths, adds less than 3e-18 to it.
_REACH = 9.0


def series_error(terms: int = _TERMS, cell: float = _CELL) -> float:
    """Most that the truncated series misses of a kernel whose height is 1.

    Hermite functions are below 1.09 sqrt(2^p p!), so what is left out is below the sum over
    p >= terms of 1.09 (sqrt(2) r)^p / sqrt(p!), r being the largest distance from a cell's
    middle in units of sqrt(2) kernel widths.
    """
    r = cell / 2 / math.sqrt(2)
    return sum(1.09 * (math.sqrt(2) * r) ** p / math.sqrt(math.factorial(p)) for p in range(terms, terms + 40))


def density(df: DataFrame, column: str, points: int = K.DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density over the range of the present values (Scott's width).

    A fast Gauss transform: rows are summed up per cell of half a kernel width, as moments
    around the cell's middle, and each grid point is a short Hermite series of the cells near
    it. What a row costs does not depend on the number of grid points, and the error is below
    `series_error()` (4e-12) of a kernel's height. Cells that reach no grid point are not
    fetched, so there are some 40 cells per point at most.
    """
    v = ref(column).cast("double")
    m = collect_metrics(
        df, {"lo": F.min(v), "hi": F.max(v), "n": F.count(v), "sd": F.stddev_samp(v)}
    )
    schema = "x double, density double"
    if m["n"] < 2 or not m["sd"]:
        return small_table(df.sparkSession, [], schema)
    width = m["sd"] * m["n"] ** (-1 / 5)
    step = (m["hi"] - m["lo"]) / (points - 1)
    grid = np.array([m["lo"] + i * step for i in range(points)])
    cell = F.floor((v - F.lit(m["lo"])) / F.lit(_CELL * width))
    near = F.abs(v - F.lit(m["lo"]) - F.round((v - F.lit(m["lo"])) / F.lit(step)) * F.lit(step))
    placed = df.filter(v.isNotNull() & (near < F.lit((_REACH + _CELL) * width))).select(v.alias("v"), cell.alias("cell"))
    middle = F.lit(m["lo"]) + (F.col("cell") + 0.5) * F.lit(_CELL * width)
    t = (F.col("v") - middle) / F.lit(math.sqrt(2) * width)
    placed = placed.select("cell", t.alias("t"))
    sums = [F.sum(F.pow("t", F.lit(float(p)))).alias(f"m{p}") for p in range(_TERMS)]
    cells = placed.groupBy("cell").agg(*sums).toPandas()
    middles = m["lo"] + (cells["cell"].to_numpy(float) + 0.5) * _CELL * width
    weights = cells[[f"m{p}" for p in range(_TERMS)]].to_numpy(float) / [math.factorial(p) for p in range(_TERMS)]
    total = np.zeros(points)
    for i, x in enumerate(grid):
        at = np.abs(x - middles) < (_REACH + _CELL) * width
        total[i] = _series((x - middles[at]) / (math.sqrt(2) * width), weights[at])
    scale = m["n"] * width * math.sqrt(2 * math.pi)
    return small_table(df.sparkSession, list(zip(grid.tolist(), (total / scale).tolist())), schema)


def _series(u: np.ndarray, weights: np.ndarray) -> float:
    """Sum over cells and terms of weight times Hermite function."""
    before, now = np.zeros_like(u), np.exp(-u * u)
    total = 0.0
    for p in range(weights.shape[1]):
        total += float(weights[:, p] @ now)
        before, now = now, 2 * u * now - 2 * p * before
    return total


def box_stats(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = K.IQR_FACTOR
) -> DataFrame:
    """Quartiles, fences, whisker ends and number of fliers per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    present = collect_metrics(df, {c: F.count(ref(c)) for c in columns})
    q = quantiles(df, columns, (0.25, 0.5, 0.75), present)
    columns = [c for c in columns if q[c][0] is not None]
    fences = {c: (q[c][0] - factor * (q[c][2] - q[c][0]), q[c][2] + factor * (q[c][2] - q[c][0])) for c in columns}
    metrics = {}
    for c in columns:
        v = ref(c).cast("double")
        inside = F.when(~is_outside(v, fences[c]), v)
        metrics[(c, "low")] = F.min(inside)
        metrics[(c, "high")] = F.max(inside)
        metrics[(c, "fliers")] = count_where(is_outside(v, fences[c]))
    m = collect_metrics(df, metrics)
    rows = [
        (c, *q[c], *fences[c], m[(c, "low")], m[(c, "high")], m[(c, "fliers")]) for c in columns
    ]
    return small_table(
        df.sparkSession,
        rows,
        "column string, q25 double, q50 double, q75 double, lower_fence double, "
        "upper_fence double, whisker_low double, whisker_high double, n_fliers long",
    )


def flier_rows(df: DataFrame, column: str, factor: float = K.IQR_FACTOR) -> DataFrame:
    """Values drawn beyond the whiskers, as a table."""
    from limpid.operators.outliers import outlier_rows

    return outlier_rows(df, column, factor).select(ref(column))


def top_bars(df: DataFrame, column: str, n: int = K.TOP_CATEGORIES) -> DataFrame:
    """The most frequent values of one column."""
    return top_values_of(df, [column], n).select("value", "n")


def scatter_sample(
    df: DataFrame, row_id: str, k: int, columns: Sequence[str] | None = None, seed: str = ""
) -> DataFrame:
    """At most `k` complete rows of the numeric columns, with their id: those whose id has the
    smallest digest. Rows without an id are left out.

    The sample depends on ids alone, so any partitioning gives the same rows, and samples of two
    parts of a table merge into that of the whole by taking the smallest again. Each task keeps
    its `k` smallest and sends no others. Rows that share an id follow each other by value.
    """
    cols = [c for c in (numeric_columns(df) if columns is None else list(columns)) if c != row_id]
    kept = complete_rows(df, [row_id, *cols])
    digest = F.md5(F.encode(F.concat(F.lit(seed), F.coalesce(ref(row_id).cast("string"), F.lit(""))), "UTF-8"))
    return kept.orderBy(digest, ref(row_id), *map(ref, cols)).limit(k)


def scatter_points(
    df: DataFrame, columns: Sequence[str] | None = None, max_columns: int | None = None
) -> DataFrame:
    """Complete rows of the numeric columns (all, or the first few): every point of every pair."""
    cols = (numeric_columns(df) if columns is None else list(columns))[:max_columns]
    if len(cols) < 2:
        raise ValueError("a scatter matrix needs at least two numeric columns")
    return complete_rows(df, cols)

"""Shape and descriptive statistics of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from limpid.operators.aggregate import collect_metrics, small_table
from limpid.operators.quantiles import QUARTILES, quantiles
from limpid.operators.schema import numeric_columns, ref, type_name


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns; an empty table cannot be profiled."""
    n = df.count()
    if n == 0:
        raise ValueError("cannot profile an empty table")
    return small_table(df.sparkSession, [(n, len(df.columns))], "n_rows long, n_columns long")


def column_types(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema)]
    return small_table(df.sparkSession, rows, "position long, column string, type string")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    metrics = {}
    for c in columns:
        v = ref(c).cast("double")
        metrics[(c, "count")] = F.count(v)
        metrics[(c, "mean")] = F.avg(v)
        metrics[(c, "std")] = F.stddev_samp(v)
        metrics[(c, "min")] = F.min(v)
        metrics[(c, "max")] = F.max(v)
    m = collect_metrics(df, metrics)
    q = quantiles(df, columns, QUARTILES, {c: m[(c, "count")] for c in columns})
    rows = [
        (c, m[(c, "count")], m[(c, "mean")], m[(c, "std")], m[(c, "min")], *q[c], m[(c, "max")])
        for c in columns
    ]
    return small_table(
        df.sparkSession,
        rows,
        "column string, count long, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double",
    )

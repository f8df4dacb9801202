"""Aggregation helpers: one scan for many metrics, one row per column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Aggregates per job. Wider tables are read in column chunks, each scan reading
# only its own columns.
WIDTH = 240


def collect_metrics(df: DataFrame, metrics: Mapping[str, Column]) -> dict:
    """Evaluate named aggregates over the whole table; one small row per chunk."""
    items = list(metrics.items())
    out: dict = {}
    for start in range(0, len(items), WIDTH):
        chunk = items[start:start + WIDTH]
        row = df.agg(*[e.alias(f"m{i}") for i, (_, e) in enumerate(chunk)]).first()
        out.update({name: row[i] for i, (name, _) in enumerate(chunk)})
    return out


def per_column_table(
    df: DataFrame,
    columns: Iterable[str],
    metrics: Mapping[str, Callable[[str], Column]],
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Lazy table with one row per column, from one wide aggregate per chunk."""
    columns = list(columns)
    step = max(1, WIDTH // max(1, len(metrics)))
    parts = []
    for start in range(0, len(columns), step):
        chunk = columns[start:start + step]
        wide = df.agg(
            *[fn(c).alias(f"{i}_{m}") for i, c in enumerate(chunk) for m, fn in metrics.items()]
        )
        parts.append(
            wide.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(c).alias("column"),
                                *[F.col(f"{i}_{m}").alias(m) for m in metrics],
                            )
                            for i, c in enumerate(chunk)
                        ]
                    )
                )
            )
        )
    out = reduce(DataFrame.unionByName, parts)
    for name, expr in (derived or {}).items():
        out = out.withColumn(name, expr)
    return out


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A metric table held by the driver: a few rows per column, never data rows."""
    return spark.createDataFrame(rows, schema)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part / whole * 100, digits)

"""Missing values: counts, near-empty columns, poorly filled rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from limpid import constants as K
from limpid.operators.aggregate import collect_metrics, count_where, per_column_table, percent
from limpid.operators.sampling import first_n_per_group, with_order
from limpid.operators.schema import ref


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column."""
    return per_column_table(
        df,
        df.columns,
        {"n_missing": lambda c: count_where(ref(c).isNull()), "n_rows": lambda c: F.count("*")},
        {"pct_missing": percent(F.col("n_missing"), F.col("n_rows"))},
    ).select("column", "n_missing", "pct_missing")


def missing_summary(df: DataFrame) -> DataFrame:
    """Only the columns with missing values, largest count first."""
    return (
        per_column_table(
            df,
            df.columns,
            {"n_missing": lambda c: count_where(ref(c).isNull()), "n_rows": lambda c: F.count("*")},
            {"pct_missing": percent(F.col("n_missing"), F.col("n_rows"), 1)},
        )
        .filter("n_missing > 0")
        .select("column", "n_missing", "pct_missing")
        .orderBy(F.col("n_missing").desc(), "column")
    )


def near_empty_columns(df: DataFrame) -> list[str]:
    """Columns missing in at least 95 % of rows; none on an empty table."""
    m = collect_metrics(
        df,
        {"": F.count("*"), **{c: count_where(ref(c).isNull()) for c in df.columns}},
    )
    rows = m.pop("")
    return [c for c, n in m.items() if rows and n / rows >= K.EMPTY_COLUMN_RATIO]


def drop_near_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    dropped = near_empty_columns(df)
    gone = set(dropped)
    return df.select(*[ref(c) for c in df.columns if c not in gone]), dropped


def row_null_percent(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Share of missing cells of a row, in percent."""
    columns = list(columns or df.columns)
    nulls = reduce(lambda a, b: a + b, [ref(c).isNull().cast("int") for c in columns])
    return F.round(nulls / len(columns) * 100, 2)


def _is_empty(pct: Column) -> Column:
    return pct > K.ROW_EMPTY_PCT


def _is_partial(pct: Column) -> Column:
    return pct.between(K.ROW_PARTIAL_PCT, K.ROW_EMPTY_PCT)


def row_quality(df: DataFrame) -> DataFrame:
    """How many rows are empty, and how many are partly empty."""
    pct = df.select(row_null_percent(df).alias("pct"))
    return pct.agg(
        F.count("*").alias("n_rows"),
        count_where(_is_empty(F.col("pct"))).alias("full_empty"),
        count_where(_is_partial(F.col("pct"))).alias("partially_empty"),
    )


def problem_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every empty or partly empty row, by the given identifying columns."""
    pct = F.col("null_pct")
    return (
        df.select(*[ref(c) for c in keep], row_null_percent(df).alias("null_pct"))
        .filter(_is_empty(pct) | _is_partial(pct))
        .withColumn("kind", F.when(_is_empty(pct), "full_empty").otherwise("partially_empty"))
    )


def row_alerts(df: DataFrame, order_by: str | None = None, shown: int = K.ROW_IDS_SHOWN) -> DataFrame:
    """Alerts on poorly filled rows.

    One alert for empty rows, and one for each missing percentage with its number of rows;
    each names its first `shown` rows.
    """
    ordered, order = with_order(df, order_by)
    rows = ordered.select(
        ref(order[0]).alias("row_id"), row_null_percent(df).alias("percentage")
    ).filter(F.col("percentage") >= K.ROW_PARTIAL_PCT)
    counts = rows.groupBy("percentage").agg(F.count("*").alias("n_rows"))
    partial = rows.filter(_is_partial(F.col("percentage")))
    first = (
        first_n_per_group(partial, ["percentage"], [F.col("row_id")], shown)
        .groupBy("percentage")
        .agg(F.array_sort(F.collect_list("row_id")).alias("rows"))
    )
    groups = counts.filter(_is_partial(F.col("percentage"))).join(first, "percentage")
    alerts = groups.select(F.lit("row_partially_empty").alias("type"), "percentage", "n_rows", "rows")
    empty = (
        counts.filter(_is_empty(F.col("percentage")))
        .agg(F.sum("n_rows").alias("n_rows"))
        .filter("n_rows > 0")
        .select(
            F.lit("row_full_empty").alias("type"),
            F.lit(None).cast("double").alias("percentage"),
            "n_rows",
            F.array().cast(alerts.schema["rows"].dataType).alias("rows"),
        )
    )
    return empty.unionByName(alerts)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The chosen columns on rows where none of them is missing."""
    return df.select(*[ref(c) for c in columns]).dropna()

"""Value counts: the long table behind categories, modes and format checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limpid import constants as K
from limpid.functions.text import strip
from limpid.operators.aggregate import percent, small_table
from limpid.operators.sampling import first_n_per_group
from limpid.operators.schema import ref, text_columns


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of (column, value), one per cell, values as text.

    Expressions on `value` are compiled once, however wide the table is.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(cells))


def text_metrics(
    df: DataFrame, columns: Sequence[str], metrics: Mapping[str, Callable[[Column], Column]]
) -> dict[str, dict]:
    """Aggregates of each text column: one scan, one small row per column."""
    columns = list(columns)
    if not columns:
        return {}
    names = list(metrics)
    found = {
        r["column"]: {m: r[m] for m in names}
        for r in unpivoted(df, columns)
        .groupBy("column")
        .agg(*[fn(F.col("value")).alias(m) for m, fn in metrics.items()])
        .collect()
    }
    return {c: found.get(c, dict.fromkeys(names, 0)) for c in columns}


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) for every distinct value, missing ones included.

    One shuffle, combined map-side: a value that fills a third of the table
    crosses the network once per task.
    """
    columns = text_columns(df) if columns is None else list(columns)
    return unpivoted(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


# Of HyperLogLog sketches: 2^LG_K registers.
LG_K = 14
# Longer values are grouped by digest where only their number matters.
LONG_VALUE = 32


def _short(v: Column) -> Column:
    """The value, or its digest where it is long."""
    return F.when(F.length(v) > LONG_VALUE, F.sha2(v, 256)).otherwise(v)


def key_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Like `value_counts` where the values themselves are not reported.

    A long value is represented by its SHA-256, so a column of documents shuffles 64
    bytes per distinct text. Digests are longer than any value kept as it is, so the
    two never meet.
    """
    columns = text_columns(df) if columns is None else list(columns)
    return (
        unpivoted(df, columns)
        .select("column", _short(F.col("value")).alias("value"))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def categorical_profile(counts: DataFrame) -> DataFrame:
    """Cardinality, fill rate and skew per column, from value or key counts."""
    present = F.when(F.col("value").isNotNull(), F.col("n"))
    base = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(present), F.lit(0)).alias("n_present"),
        F.count("value").alias("cardinality_absolute"),
        F.max(present).alias("top"),
    )
    skew = F.coalesce(percent(F.col("top"), F.col("n_present")), F.lit(0.0))
    return base.select(
        "column",
        "cardinality_absolute",
        percent(F.col("cardinality_absolute"), F.col("n_rows")).alias("cardinality_relative"),
        percent(F.col("n_present"), F.col("n_rows")).alias("sparsity_ratio"),
        skew.alias("skewness_frequency"),
        (skew > K.SKEW_PCT).alias("is_high_skewness"),
    )


def top_values(counts: DataFrame, n: int = K.TOP_CATEGORIES) -> DataFrame:
    """The `n` most frequent values of each column; ties by value."""
    present = counts.filter(F.col("value").isNotNull())
    order = [F.col("n").desc(), F.col("value").asc()]
    return first_n_per_group(present, ["column"], order, n, spread=False)


def modes(counts: DataFrame) -> DataFrame:
    """The most frequent value of each column; the smallest one on ties."""
    return top_values(counts, 1)


def format_anomalies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: stray edge spaces, and case variations.

    The case flag needs one mixed-case value and one lowercased value seen twice; it brings the
    space message with it. One scan without a shuffle of values tells stray spaces and mixed case;
    only columns with a mixed-case value are grouped by lowercased value, by digest where it is long.
    """
    columns = text_columns(df) if columns is None else list(columns)
    v = F.col("value")
    mixed = (v != F.lower(v)) & (v != F.upper(v))
    cells = unpivoted(df, columns).filter(v.isNotNull())
    flags = cells.groupBy("column").agg(
        F.bool_or(v != strip(v)).alias("edge"), F.bool_or(mixed).alias("mixed")
    ).collect()
    cased = [r["column"] for r in flags if r["mixed"]]
    repeated = set()
    if cased:
        lowered = unpivoted(df, cased).filter(v.isNotNull()).groupBy("column", _short(F.lower(v)).alias("low"))
        twice = lowered.agg(F.count("*").alias("n")).filter("n > 1").select("column").distinct()
        repeated = {r["column"] for r in twice.collect()}
    rows = [(r["column"], r["edge"] or r["column"] in repeated, r["column"] in repeated) for r in flags]
    return small_table(df.sparkSession, rows, "column string, space_anomaly boolean, case_anomaly boolean")


def case_targets(anomalies: DataFrame) -> DataFrame:
    """Columns whose reported anomalies call for the case treatment."""
    return anomalies.filter("case_anomaly").select("column")


def column_overview(df: DataFrame) -> DataFrame:
    """Type, missing values and distinct values of every column."""
    from limpid.operators.schema import type_name

    types = small_table(
        df.sparkSession,
        [(f.name, type_name(f.dataType)) for f in df.schema],
        "column string, type string",
    )
    stats = (
        key_counts(df, df.columns)
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
            F.count("value").alias("n_distinct"),
        )
    )
    return F.broadcast(types).join(stats, "column", "left").select(
        "column",
        "type",
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
    )


def distinct_sketches(
    df: DataFrame, columns: Sequence[str] | None = None, by: Column | None = None, lg_k: int = LG_K
) -> DataFrame:
    """(part, column, n_present, sketch): a HyperLogLog sketch of each column's present values.

    A sketch is some kilobytes whatever the column holds, and is all that leaves a task. `by`
    cuts the table into parts, days for instance, whose sketches can be kept and united.
    """
    columns = list(df.columns) if columns is None else list(columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in columns])
    part = (F.lit(None).cast("string") if by is None else by.cast("string")).alias("part")
    long = df.select(part, F.inline(cells))
    sketch = F.hll_sketch_agg("value", F.lit(lg_k)).alias("sketch")
    return long.groupBy("part", "column").agg(F.count("value").alias("n_present"), sketch)


def united_sketches(sketches: DataFrame) -> DataFrame:
    """(column, n_present, n_distinct_estimate) over all parts of a table of sketches."""
    return sketches.groupBy("column").agg(
        F.sum("n_present").alias("n_present"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct_estimate"),
    )


def sketch_bound(lg_k: int = LG_K) -> float:
    """Relative error that an estimate exceeds in about one case in 700: three standard errors
    of a union."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def identifier_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: whether nearly every present value is distinct."""
    columns = text_columns(df) if columns is None else list(columns)
    base = key_counts(df, columns).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_present"),
        F.count("value").alias("n_distinct"),
    )
    ratio = F.col("n_distinct") / F.when(F.col("n_present") > 0, F.col("n_present"))
    flag = (F.col("n_present") >= K.IDENTIFIER_MIN_VALUES) & (ratio >= K.IDENTIFIER_RATIO)
    return base.select("column", "n_present", "n_distinct", F.coalesce(flag, F.lit(False)).alias("is_identifier"))

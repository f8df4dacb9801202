"""The first n rows of each group, and the first n present values of columns.

Row order is explicit (`order_by`) or, failing that, scan order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid.operators.schema import ref as _ref

# Rows of the common prefix read for all columns at once.
PREFIX_ROWS = 1000
# First-level groups of a two-level "first n": spreads a hot group's candidates.
SPREAD = 256
_SCAN_ORDER = "__scan_order"


def with_order(df: DataFrame, order_by: Sequence[str] | str | None) -> tuple[DataFrame, list[str]]:
    """The table and the columns that define its row order."""
    if order_by is None:
        return df.withColumn(_SCAN_ORDER, F.monotonically_increasing_id()), [_SCAN_ORDER]
    return df, [order_by] if isinstance(order_by, str) else list(order_by)


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: bool = True
) -> DataFrame:
    """First `n` rows of each group, in `order`.

    Spark cuts each map task's share of a group to `n` rows before the shuffle
    (WindowGroupLimit). With `spread`, the survivors are first reduced per group
    and slice of map tasks, so a group holding most of the table never meets in
    one task before it has been cut down.
    """
    rank = "__rank"
    if spread:
        df = df.withColumn("__slice", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
        w = Window.partitionBy(*keys, "__slice").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
        df = df.drop(rank, "__slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).drop(rank)


def first_present(
    df: DataFrame,
    columns: Sequence[str],
    code: Callable[[Column], Column],
    n: int,
    order_by: Sequence[str] | str | None = None,
    prefix_rows: int = PREFIX_ROWS,
) -> dict[str, list[int]]:
    """Small codes of the first `n` present values of each text column.

    `code` turns a value into an integer. The first `prefix_rows` rows settle most
    columns: their order keys are found first, from the order columns alone, and
    only the rows up to the last of them are read in full (a range filter that
    reaches the scan). Columns too sparse to be settled there go through
    `first_n_per_group` together. Only codes reach the driver.
    """
    columns = list(columns)
    if not columns:
        return {}
    df, keys = with_order(df, order_by)
    last = df.select(*map(_ref, keys)).orderBy(*map(_ref, keys)).limit(prefix_rows)
    top, n_rows = last.agg(F.max(_ref(keys[0])), F.count("*")).first()
    if not n_rows:
        return {c: [] for c in columns}
    near = df if top is None else df.filter(_ref(keys[0]).isNull() | (_ref(keys[0]) <= F.lit(top)))
    prefix = near.orderBy(*map(_ref, keys)).limit(prefix_rows)

    def cells(table: DataFrame, names: Sequence[str]) -> DataFrame:
        values = F.array(
            *[F.struct(F.lit(columns.index(c)).alias("c"), _ref(c).alias("v")) for c in names]
        )
        order = [f"__k{i}" for i in range(len(keys))]
        long = table.select(*[_ref(k).alias(o) for k, o in zip(keys, order)], F.inline(values))
        return long.filter(F.col("v").isNotNull()).select(*order, "c", code(F.col("v")).alias("code"))

    order = [f"__k{i}" for i in range(len(keys))]
    out: dict[str, list[int]] = {c: [] for c in columns}
    in_order = lambda r: tuple((r[o] is not None, r[o]) for o in order)
    for r in sorted(cells(prefix, columns).collect(), key=in_order):
        out[columns[r["c"]]].append(r["code"])
    short = [c for c in columns if len(out[c]) < n]
    if short and n_rows == prefix_rows:
        picked = first_n_per_group(cells(df, short), ["c"], [F.col(o) for o in order], n)
        for c in short:
            out[c] = []
        for r in sorted(picked.collect(), key=in_order):
            out[columns[r["c"]]].append(r["code"])
    return {c: codes[:n] for c, codes in out.items()}

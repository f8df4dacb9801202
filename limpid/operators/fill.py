"""Filling missing values: median for numbers, most frequent value otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import constants as K
from limpid.operators.aggregate import collect_metrics, count_where
from limpid.operators.frequent import top_values_of
from limpid.operators.quantiles import quantiles
from limpid.operators.schema import chosen, integer_columns, numeric_columns, ref


@dataclass(frozen=True)
class Fill:
    column: str
    method: str        # "median" or "mode"
    value: str         # written form, cast to `dtype`
    dtype: str         # type of the column once filled
    count: int

    def apply(self, c: Column) -> Column:
        return F.coalesce(c.cast(self.dtype), F.lit(self.value).cast(self.dtype))


def fit_fills(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Fill]:
    """Fill value of each chosen column with missing values.

    The median is exact. The mode comes from value counts, the smallest value on
    ties. An integer column with a fractional median becomes double.
    """
    cols = chosen(df.columns, columns)
    metrics = {}
    for c in cols:
        metrics[(c, "missing")] = count_where(ref(c).isNull())
        metrics[(c, "present")] = F.count(ref(c))
    m = collect_metrics(df, metrics)
    gaps = [c for c in cols if m[(c, "missing")] > 0]
    numeric, whole = set(numeric_columns(df)), set(integer_columns(df))
    types = {f.name: f.dataType for f in df.schema}

    fills: dict[str, Fill] = {}
    numbers = [c for c in gaps if c in numeric]
    medians = quantiles(df, numbers, (0.5,), {c: m[(c, "present")] for c in numbers})
    for c in numbers:
        (median,) = medians[c]
        if median is None:
            continue
        dtype = "double" if c in whole and median % 1 else types[c].simpleString()
        value = str(int(median)) if c in whole and not median % 1 else repr(median)
        fills[c] = Fill(c, "median", value, dtype, m[(c, "missing")])

    others = [c for c in gaps if c not in numeric]
    found = (
        {r["column"]: r["value"] for r in top_values_of(df, others, 1).collect()} if others else {}
    )
    for c in others:
        value = found.get(c)
        if value is None:
            if not isinstance(types[c], T.StringType):
                continue
            value = K.UNKNOWN
        fills[c] = Fill(c, "mode", value, types[c].simpleString(), m[(c, "missing")])
    return {c: fills[c] for c in cols if c in fills}


def fill(df: DataFrame, fills: Mapping[str, Fill]) -> DataFrame:
    return df.select(*[fills[c].apply(ref(c)).alias(c) if c in fills else ref(c) for c in df.columns])


def fill_missing(
    df: DataFrame, columns: Sequence[str] | None = None
) -> tuple[DataFrame, dict[str, Fill]]:
    fills = fit_fills(df, columns)
    return fill(df, fills), fills

"""Column selection by type and small helpers on schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def ref(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers only: booleans are not numbers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]


def chosen(candidates: Iterable[str], asked: Iterable[str] | None) -> list[str]:
    """Restrict candidates to the asked names, in table order; None keeps all."""
    candidates = list(candidates)
    if asked is None:
        return candidates
    wanted = set(asked)
    return [c for c in candidates if c in wanted]


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: turn it into NULL once, at the entry."""
    floats = set(float_columns(df))
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(ref(c)), ref(c)).alias(c) if c in floats else ref(c)
            for c in df.columns
        ]
    )

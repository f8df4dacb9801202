"""IQR outliers: bounds, counts, rows and clipping."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import constants as K
from limpid.functions.numbers import rough_number
from limpid.functions.text import strip
from limpid.operators.aggregate import collect_metrics, count_where, small_table
from limpid.operators.quantiles import quantiles
from limpid.operators.schema import chosen, numeric_columns, ref

Bounds = dict[str, tuple[float, float]]


def tukey_fences(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    factor: float | Mapping[str, float] = K.IQR_FACTOR,
    present: Mapping[str, int] | None = None,
) -> Bounds:
    """``(q1 - k*iqr, q3 + k*iqr)`` of each column that has values, flat ones included."""
    columns = numeric_columns(df) if columns is None else list(columns)
    out = {}
    for c, (q1, q3) in quantiles(df, columns, (0.25, 0.75), present).items():
        if q1 is not None:
            k = factor.get(c, K.IQR_FACTOR) if isinstance(factor, Mapping) else factor
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_bounds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    factor: float | Mapping[str, float] = K.IQR_FACTOR,
    present: Mapping[str, int] | None = None,
) -> Bounds:
    """Fences that can be used to clip: two values at least, and a spread."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if present is None:
        present = collect_metrics(df, {c: F.count(ref(c)) for c in columns})
    fences = tukey_fences(df, columns, factor, present)
    return {
        c: b for c, b in fences.items() if present[c] >= K.IQR_MIN_VALUES and b[0] != b[1]
    }


def is_outside(c: Column, bounds: tuple[float, float]) -> Column:
    return (c < F.lit(bounds[0])) | (c > F.lit(bounds[1]))


def count_outside(df: DataFrame, bounds: Bounds) -> dict[str, int]:
    return collect_metrics(df, {c: count_where(is_outside(ref(c), b)) for c, b in bounds.items()})


def outlier_counts(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = K.IQR_FACTOR
) -> dict[str, int]:
    """Values outside usable bounds, per numeric column; 0 where there are none to use."""
    columns = numeric_columns(df) if columns is None else list(columns)
    bounds = iqr_bounds(df, columns, factor)
    found = count_outside(df, bounds) if bounds else {}
    return {c: found.get(c, 0) for c in columns}


def profile_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count and fences of the columns with outliers; flat columns are not exempt here."""
    fences = tukey_fences(df, columns)
    found = count_outside(df, fences) if fences else {}
    rows = [(c, n, *fences[c]) for c, n in found.items() if n > 0]
    return small_table(
        df.sparkSession,
        rows,
        "column string, n_outliers long, lower_bound double, upper_bound double",
    )


def outlier_rows(df: DataFrame, column: str, factor: float = K.IQR_FACTOR) -> DataFrame:
    """Every row whose value lies outside the fences, as a table."""
    fences = tukey_fences(df, [column], factor)
    if column not in fences:
        return df.filter(F.lit(False))
    return df.filter(is_outside(ref(column), fences[column]))


def estimated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns read as numbers by the quick estimate used before typing."""
    return df.select(*[rough_number(strip(ref(c))).alias(c) for c in columns])


def latent_outliers(df: DataFrame, candidates: Sequence[str]) -> dict[str, int]:
    """Outliers that convertible text columns would show once typed."""
    if not candidates:
        return {}
    rough = estimated(df, candidates)
    present = collect_metrics(rough, {c: F.count(ref(c)) for c in candidates})
    usable = [c for c in candidates if present[c] >= K.LATENT_MIN_VALUES]
    bounds = iqr_bounds(rough, usable, present=present)
    found = count_outside(rough, bounds) if bounds else {}
    return {c: n for c, n in found.items() if n > 0}


def outlier_summary(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Outliers of typed columns, then those hidden in convertible text columns."""
    fences = tukey_fences(df)
    typed = count_outside(df, fences) if fences else {}
    rows = [(c, n, False) for c, n in typed.items() if n > 0]
    rows += [(c, n, True) for c, n in latent_outliers(df, candidates).items()]
    return small_table(df.sparkSession, rows, "column string, n_outliers long, latent boolean")


def clip_limits(bounds: tuple[float, float], dt: T.DataType) -> tuple[float, float]:
    """Integer columns are clipped to the whole numbers inside the fence."""
    if isinstance(dt, T.IntegralType):
        return math.ceil(bounds[0]), math.floor(bounds[1])
    return bounds


def clipped(c: Column, limits: tuple[float, float], dt: T.DataType) -> Column:
    low, high = (F.lit(v).cast(dt) for v in limits)
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def clip_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    thresholds: Mapping[str, float] | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """Bring values back inside the bounds, and count them per column."""
    cols = chosen(numeric_columns(df), columns)
    bounds = iqr_bounds(df, cols, thresholds or {})
    found = {c: n for c, n in (count_outside(df, bounds) if bounds else {}).items() if n > 0}
    types = {f.name: f.dataType for f in df.schema}
    out = df.select(
        *[
            clipped(ref(c), clip_limits(bounds[c], types[c]), types[c]).alias(c)
            if c in found
            else ref(c)
            for c in df.columns
        ]
    )
    return out, found

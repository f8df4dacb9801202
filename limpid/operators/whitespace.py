"""White space treatment of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from limpid.functions.text import squeeze_whitespace
from limpid.operators.aggregate import count_where
from limpid.operators.counts import text_metrics
from limpid.operators.schema import ref, text_columns


def squeezed(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(
        *[squeeze_whitespace(ref(c)).alias(c) if c in texts else ref(c) for c in df.columns]
    )


def clean_whitespace(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Trim and squeeze, and count the values that really changed per column."""
    found = text_metrics(
        df, text_columns(df), {"changed": lambda v: count_where(v != squeeze_whitespace(v))}
    )
    counts = {c: m["changed"] for c, m in found.items()}
    return squeezed(df), {c: n for c, n in counts.items() if n > 0}

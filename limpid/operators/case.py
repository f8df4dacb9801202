"""Case treatment: lowercase the text columns that are words, not codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from limpid import constants as K
from limpid.functions.text import changes_when_lowered, lower_guarded
from limpid.operators.aggregate import count_where
from limpid.operators.counts import text_metrics
from limpid.operators.schema import chosen, ref, text_columns
from limpid.operators.typing import full_scan_shares, sample_allows_lowering, sample_codes


def lowerable_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | None = None,
    full_scan: bool = False,
    rate: float = K.FULL_SCAN_RATE,
) -> list[str]:
    """Text columns whose first present values are words; an empty choice means all.

    With `full_scan` all present values decide: some have letters, and a share of `rate` of
    them are no short codes.
    """
    cols = chosen(text_columns(df), columns or None)
    if full_scan:
        m = full_scan_shares(df, cols)
        return [c for c in cols if m[c]["letters"] and m[c]["short_codes"] <= (1 - rate) * m[c]["present"]]
    codes = sample_codes(df, cols, order_by)
    return [c for c in cols if sample_allows_lowering(codes[c])]


def normalize_case(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: str | None = None, **decision
) -> tuple[DataFrame, dict[str, int]]:
    """Lowercase, and count the values that changed per column."""
    cols = lowerable_columns(df, columns, order_by, **decision)
    found = text_metrics(df, cols, {"changed": lambda v: count_where(changes_when_lowered(v))})
    changed = {c: m["changed"] for c, m in found.items() if m["changed"]}
    out = df.select(
        *[lower_guarded(ref(c)).alias(c) if c in changed else ref(c) for c in df.columns]
    )
    return out, changed

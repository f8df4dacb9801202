"""Exact duplicates, found by fingerprint before whole rows are moved.

Shuffling every column of a large table to find a few copies is the most
expensive step of a cleaning run. Rows are first grouped by an 8-byte hash; only
rows whose hash occurs twice are then compared in full. Different rows that share
a hash are all kept, because the full comparison decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from limpid.operators.schema import ref
from limpid.storage import materialised

FINGERPRINT = "__fingerprint"
REMOVED = "__removed"
# Repeated hashes sent to every executor: 8 bytes each, so 16 MB at most.
BROADCAST_FINGERPRINTS = 2_000_000


def fingerprint(columns: Sequence[str]) -> Column:
    """Hash of all columns; the null mask is included because the hash skips NULL."""
    nulls = F.concat(*[F.when(ref(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(nulls, *[ref(c) for c in columns])


def unique_rows(df: DataFrame, columns: Sequence[str], row: str | None = None) -> DataFrame:
    """One row per distinct combination of `columns`; with `row`, its smallest row id.

    Copies combine map-side, so a group of copies of any size costs one row per task.
    """
    if row is None:
        return df.select(*[ref(c) for c in columns]).dropDuplicates()
    return df.groupBy(*[ref(c) for c in columns]).agg(F.min(row).alias(row))


def _repeated(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Fingerprints that occur more than once with their rows (n), how many, and their rows."""
    repeated = materialised(df.groupBy(FINGERPRINT).agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    return repeated, *repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()


def remove_duplicates(
    df: DataFrame,
    row: str | None = None,
    broadcast_limit: int = BROADCAST_FINGERPRINTS,
) -> tuple[DataFrame, int]:
    """One row per group of identical rows, and how many rows went away."""
    return without_duplicates(df, row, broadcast_limit)[:2]


def without_duplicates(
    df: DataFrame,
    row: str | None = None,
    broadcast_limit: int = BROADCAST_FINGERPRINTS,
) -> tuple[DataFrame, int, DataFrame | None]:
    """One row per group of identical rows, how many rows went away, and what they were: each such
    row once with the number (`REMOVED`) of its removed copies, or None where the whole table was grouped.

    `df` may already carry a `FINGERPRINT` column; then the search reads that column
    only. No repeated hash: nothing moves. Few: the candidate rows alone are
    shuffled, and everything else passes by a map-side lookup of the repeated
    hashes. More than `broadcast_limit`: the whole table is grouped.
    """
    columns = [c for c in df.columns if c not in (FINGERPRINT, row)]
    kept = columns + ([row] if row else [])
    if FINGERPRINT not in df.columns:
        df = df.withColumn(FINGERPRINT, fingerprint(columns))
    repeated, n_groups, n_rows = _repeated(df)
    if not n_groups:
        return df.select(*[ref(c) for c in kept]), 0, None
    if n_groups > broadcast_limit:
        unique = materialised(unique_rows(df, columns, row), "unique")
        return unique.select(*[ref(c) for c in kept]), df.count() - unique.count(), None
    small = F.broadcast(repeated.select(FINGERPRINT))
    copies = df.join(small, FINGERPRINT, "left_semi").groupBy(*[ref(c) for c in columns])
    unique = materialised(
        copies.agg((F.count("*") - 1).alias(REMOVED), *([F.min(row).alias(row)] if row else [])), "unique"
    )
    alone = df.join(small, FINGERPRINT, "left_anti").select(*[ref(c) for c in kept])
    return alone.unionByName(unique.select(*[ref(c) for c in kept])), n_rows - unique.count(), unique


def drop_duplicates(df: DataFrame, row: str | None = None) -> tuple[DataFrame, int]:
    """Exact duplicates removed, first one kept, with the number removed."""
    return remove_duplicates(df, row)


def duplicate_count(df: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """Rows beyond the first of each group of identical rows.

    Only rows whose fingerprint is repeated are compared in full; copies combine map-side. With
    more repeated fingerprints than may be broadcast, the whole table is grouped.
    """
    columns = [ref(c) for c in df.columns]
    keyed = df.withColumn(FINGERPRINT, fingerprint(df.columns))
    repeated, n_groups, _ = _repeated(keyed)
    few = n_groups <= broadcast_limit
    rows = keyed.join(F.broadcast(repeated.select(FINGERPRINT)), FINGERPRINT, "left_semi") if few else keyed
    copies = rows.groupBy(FINGERPRINT, *columns).agg(F.count("*").alias("__copies"))
    return copies.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("n_duplicates"))

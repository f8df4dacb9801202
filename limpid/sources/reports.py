"""Reports of runs: stored by run, read back together, compared.

`folder/<report>/run-<run id>` holds one report of one run. Writing a run again replaces it, so a
job that is repeated after a failure leaves one copy, and an empty report replaces one with
rows. The run id stands in the rows, and its folder is all that a reader of one run opens.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid.operators.schema import numeric_columns, ref

RUN_ID = "run_id"
_SAFE = re.compile(r"[A-Za-z0-9_-]+")


def _folder(folder: str, report: str, run_id: str) -> str:
    for name in (report, run_id):
        if not _SAFE.fullmatch(name):
            raise ValueError(f"not a name of letters, digits, - and _: {name!r}")
    return f"{folder}/{report}/run-{run_id}"


def write_reports(tables: Mapping[str, DataFrame], folder: str, run_id: str) -> None:
    """The named tables of a run, in place of what the store has of that run."""
    for name, table in tables.items():
        if RUN_ID in table.columns:
            table = table.drop(RUN_ID)
        table.withColumn(RUN_ID, F.lit(run_id)).write.mode("overwrite").parquet(_folder(folder, name, run_id))


def read_reports(spark: SparkSession, folder: str, report: str, runs: Sequence[str] | None = None) -> DataFrame:
    """Rows of one report, of the given runs or of all. Columns that came later are null in
    earlier runs."""
    paths = [f"{folder}/{report}/run-*"] if runs is None else [_folder(folder, report, r) for r in runs]
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def run_ids(spark: SparkSession, folder: str, report: str) -> DataFrame:
    """run_id and number of rows of every run that has rows, in order of time for stamps."""
    return read_reports(spark, folder, report).groupBy(RUN_ID).agg(F.count("*").alias("n_rows")).orderBy(RUN_ID)


def compared_runs(
    spark: SparkSession, folder: str, report: str, before: str, after: str, keys: Sequence[str]
) -> DataFrame:
    """Every numeric column of a report in two runs, matched by `keys` (nulls match nulls).

    keys, metric, before, after, delta and status: `added` and `removed` rows stand in one run
    only, `changed` ones differ, the others are the `same`.
    """
    both = read_reports(spark, folder, report, [before, after])
    metrics = [c for c in numeric_columns(both) if c not in keys]
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), ref(c).cast("double").alias("value")) for c in metrics])
    long = both.select(RUN_ID, *[ref(k) for k in keys], F.inline(cells))
    value = lambda run: F.max(F.when(F.col(RUN_ID) == run, F.col("value")))
    there = lambda run: F.count_if(F.col(RUN_ID) == run) > 0
    found = long.groupBy(*[ref(k) for k in keys], "metric").agg(
        value(before).alias("before"), value(after).alias("after"), there(before).alias("_was"), there(after).alias("_is")
    )
    status = (
        F.when(~F.col("_was"), "added").when(~F.col("_is"), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    )
    return found.select(
        *[ref(k) for k in keys], "metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"),
        status.alias("status"),
    )

"""The account of a cleaning run, as tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from limpid import constants as K
from limpid.operators.aggregate import collect_metrics, count_where, small_table
from limpid.operators.duplicates import duplicate_count
from limpid.operators.schema import ref, type_name
from limpid.operators.typing import change_examples, mistyped_columns
from limpid.plans.cleaning import CleaningPlan, CleaningResult

AUDIT_SCHEMA = (
    "pass int, step string, column string, metric string, value double, detail string, "
    "examples array<string>"
)
IGNORED = "not requested"
# Steps whose total is a number of columns rather than a sum of values.
_COUNT_COLUMNS = {"empty_cols_dropped", "case_normalized", "types_fixed", "types_converted"}


def run_stamp(moment: datetime | None = None) -> str:
    """Stamp shared by everything one run writes; its order is the order of time."""
    return (moment or datetime.now()).strftime("%Y%m%d_%H%M%S")


def _examples(result: CleaningResult, n: int) -> dict[tuple[int, str, str], list[str]]:
    """Examples of blanked and rescaled values, by pass, step and column."""
    found = {}
    for i, cells in enumerate(result.changed, 1):
        if cells is not None:
            found.update({(i, kind, c): values for (kind, c), values in change_examples(cells, n).items()})
    return found


def audit_rows(result: CleaningResult, examples: int = K.EXAMPLES_KEPT) -> list[tuple]:
    """One row per pass, step, column and metric; a few rows per column."""
    plan = result.plan
    cited = _examples(result, examples) if examples else {}
    before = dict(plan.columns_before)
    rows: list[tuple] = []

    def add(i, step, column, metric, value, detail=None):
        rows.append((i, step, column, metric, float(value), detail, cited.get((i, step, column), [])))

    for i, p in enumerate(plan.passes, 1):
        for c in p.dropped:
            add(i, "empty_cols_dropped", c, "columns", 1)
        for c, n in p.whitespace.items():
            add(i, "whitespace_cleaned", c, "values", n)
        for c, n in p.lowered.items():
            add(i, "case_normalized", c, "values", n)
        for c in p.integers:
            add(i, "types_fixed", c, "columns", 1, f"{before[c]} -> bigint")
        for c, v in p.conversions.items():
            add(i, "types_converted", c, "columns", 1, f"string -> {v.kind}")
            if v.n_lost:
                add(i, "values_unparsed", c, "values", v.n_lost)
            if v.n_rescaled:
                add(i, "grades_rescaled", c, "values", v.n_rescaled, f"scale {v.scale:g}")
        if p.duplicates:
            add(i, "duplicates_removed", None, "rows", p.duplicates)
    last = len(plan.passes)
    if not plan.options.fill_missing:
        add(last, "missing_filled", None, "ignored", 0, IGNORED)
    for c, f in plan.fills.items():
        add(last, "missing_filled", c, "values", f.count, f"fill_{f.method}")
    if not plan.options.correct_outliers:
        add(last, "outliers_corrected", None, "ignored", 0, IGNORED)
    for c, o in plan.clips.items():
        add(last, "outliers_corrected", c, "values", o["count"], f"threshold {o['threshold']:g}")
    return rows


def audit_table(
    result: CleaningResult, run_id: str | None = None, examples: int = K.EXAMPLES_KEPT
) -> DataFrame:
    """The audit as a table; with `run_id`, as a column to partition by."""
    table = small_table(result.table.sparkSession, audit_rows(result, examples), AUDIT_SCHEMA)
    return table if run_id is None else table.withColumn("run_id", F.lit(run_id))


def step_totals(audit: DataFrame) -> DataFrame:
    """One total per step, in columns, values or rows."""
    spark = audit.sparkSession
    steps = small_table(
        spark,
        [(s, "columns" if s in _COUNT_COLUMNS else unit) for s, unit in K.STEPS],
        "step string, unit string",
    )
    totals = audit.groupBy("step").agg(
        F.sum("value").cast("bigint").alias("n_values"),
        F.count_distinct("column").alias("n_columns"),
        F.max(F.when(F.col("metric") == "ignored", True).otherwise(False)).alias("ignored"),
    )
    total = F.when(F.col("unit") == "columns", F.col("n_columns")).otherwise(F.col("n_values"))
    return totals.join(F.broadcast(steps), "step").select("step", "unit", total.alias("total"), "ignored")


def audit_summary(result: CleaningResult) -> DataFrame:
    """Rows and columns before and after, then the total of every step."""
    plan = result.plan
    spark = result.table.sparkSession
    head = small_table(
        spark,
        [
            ("rows_before", plan.rows_before),
            ("rows_after", plan.rows_after),
            ("columns_before", len(plan.columns_before)),
            ("columns_after", len(plan.columns_after)),
        ],
        "item string, total long",
    )
    steps = step_totals(audit_table(result, examples=0)).select(F.col("step").alias("item"), "total")
    return head.unionByName(steps)


def type_changes(plan: CleaningPlan, spark) -> DataFrame:
    """Columns kept by the run whose type changed."""
    after = dict(plan.columns_after)
    rows = [(c, t, after[c]) for c, t in plan.columns_before if c in after and after[c] != t]
    return small_table(spark, rows, "column string, type_before string, type_after string")


def table_metrics(df: DataFrame) -> dict[str, int]:
    m = collect_metrics(
        df, {None: F.count("*"), **{c: count_where(ref(c).isNull()) for c in df.columns}}
    )
    rows = m.pop(None)
    return {"n_rows": rows, "n_columns": len(df.columns), "n_missing": sum(m.values())}


def global_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicates and missing cells, in one row."""
    m = table_metrics(df)
    return duplicate_count(df).select(
        F.lit(m["n_rows"]).cast("bigint").alias("n_rows"),
        F.lit(m["n_columns"]).cast("bigint").alias("n_columns"),
        "n_duplicates",
        F.lit(m["n_missing"]).cast("bigint").alias("n_missing"),
    )


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and missing cells on both sides, with the difference."""
    a, b = table_metrics(before), table_metrics(after)
    rows = [(k, a[k], b[k], b[k] - a[k]) for k in a]
    return small_table(
        before.sparkSession, rows, "metric string, before long, after long, delta long"
    )


def control(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Verdict per column: its type, and whether it still reads as something else."""
    suspect = mistyped_columns(df, order_by)
    rows = [
        (f.name, type_name(f.dataType), f.name not in suspect, suspect.get(f.name)) for f in df.schema
    ]
    return small_table(
        df.sparkSession, rows, "column string, type string, well_typed boolean, reads_as string"
    )

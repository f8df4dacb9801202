"""Registered queries against their SQL twins, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check

# One or two per family; `check.py` runs all of them.
NAMES = (
    "scan_csv", "scan_excel_dir", "json_columnar_to_rows", "scan_jsonl_skip_corrupt", "corrupt_json_lines",
    "infer_schema", "problem_rows", "outlier_rows", "clean_whitespace", "parse_mixed_dates",
    "identifier_like_columns", "numeric_candidates", "rescaled_grades", "unparsed_values", "row_alerts",
    "describe_numeric", "profile_outliers", "outlier_summary", "profile_categorical", "format_anomalies",
    "column_overview", "correlation_matrix", "histogram_20", "kde_grid", "boxplot_stats",
    "drop_duplicates", "clip_outliers", "fill_missing", "cleaned_table", "cleaned_table_full", "clean_types_full", "audit_table", "global_metrics",
    "report_history", "scatter_sample", "profile_distinct_sketch",
)


@pytest.fixture(scope="module")
def con(tables):
    return check.database(tables)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, tables, name):
    assert check.compare(spark, con, tables, name).startswith(("ok", "rows-only"))


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

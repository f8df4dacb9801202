"""Every registered query: a callable of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from limpid import CleaningOptions, fit_cleaning
from limpid.catalog import made_files
from limpid.catalog.dirty_orders import TEXTS, dirty_orders
from limpid.functions import dates, numbers, text
from limpid.operators import (
    case, charts, correlation, counts, describe, duplicates, fill, frequent, missing, outliers, schema, typing,
    whitespace,
)
from limpid.operators.aggregate import count_where, small_table
from limpid.plans import audit
from limpid.plans.profile import profile
from limpid.session import tune
from limpid.sources import dialect, reports, tables, workbook
from limpid.storage import materialised, new_path, spread

Query = Callable[[SparkSession, str], DataFrame]
ALL = CleaningOptions(correct_outliers=True, fill_missing=True, order_by="id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    floats = set(schema.float_columns(df))
    return df.select(*[F.round(c, digits).alias(c) if c in floats else F.col(c) for c in df.columns])


def _names(spark: SparkSession, names: list[str]) -> DataFrame:
    return small_table(spark, [(n,) for n in names], "column string")


def _pairs(spark: SparkSession, found: dict, columns: str) -> DataFrame:
    return small_table(spark, list(found.items()), columns)


def _joined(df: DataFrame, column: str = "examples") -> DataFrame:
    return df.withColumn(column, F.array_join(column, " | "))


def _doubles(df: DataFrame) -> DataFrame:
    """Integer columns with gaps as doubles: both sides of a check then print them alike."""
    gaps = {"note_txt", "note20_txt", "whole_gap"}
    return df.select(*[F.col(c).cast("double").alias(c) if c in gaps else F.col(c) for c in df.columns])


# --- sources and sinks ------------------------------------------------------------------


def scan_parquet(spark, sf):
    return tables.load_table(spark, f"{sf}/orders.parquet")


def scan_csv(spark, sf):
    path = new_path(spark, "part-csv")
    tables.write_table(table(spark, sf, "part"), path, "csv")
    return tables.load_table(spark, path, "csv")


def detect_dialect(spark, sf):
    """Each file's dialect, then the lines each dialect reads."""
    folder = made_files.csv_dialects(table(spark, sf, "customer"), "c_name")
    found = dialect.dialects(spark, folder).select("path", "encoding", "separator")
    lines = dialect.text_lines(spark, folder).groupBy(F.col("file").alias("path")).agg((F.count("*") - 1).alias("n"))
    return found.join(lines, "path").groupBy("encoding", "separator").agg(F.sum("n").alias("n_lines"))


def sniff_format(spark, sf):
    """Formats told from content, and the rows then read."""
    path = new_path(spark, "customer-json")
    table(spark, sf, "customer").write.json(path)
    plain = new_path(spark, "orders")
    table(spark, sf, "orders").write.parquet(plain)
    out = []
    for source, folder in (("tables", plain), ("lines", path)):
        kind = tables.sniffed_format(spark, folder)
        read = tables.load_table(spark, folder, "jsonl" if kind == "json" else kind)
        out.append(read.agg(F.count("*").alias("n_rows")).select(F.lit(source).alias("source"), F.lit(kind).alias("format"), "n_rows"))
    return out[0].unionByName(out[1])


def scan_csv_ragged(spark, sf):
    """Every seventh record has a field more than the header."""
    extra = F.when(F.col("c_custkey") % 7 == 0, "more")
    folder = made_files.csv_lines(table(spark, sf, "customer"), "c_custkey,c_name", "c_custkey", "c_name", extra)
    df = tables.read_csv(spark, folder, ragged="keep")
    return df.select("c_custkey", "c_name", F.col("_overflow_1").alias("over"))


def scan_csv_losses(spark, sf):
    """The further fields of the same records, listed by a read that goes on."""
    extra = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("more"), F.col("c_custkey")))
    folder = made_files.csv_lines(table(spark, sf, "customer"), "c_custkey,c_name", "c_custkey", "c_name", extra)
    found = tables.load_with_losses(spark, folder, "csv")
    read = found.table.agg(F.lit("rows read").alias("kind"), F.count("*").cast("string").alias("text"))
    return found.losses.select("kind", "text").unionByName(read)


def scan_csv_mixed_headers(spark, sf):
    """Half of the rows in files whose columns stand in another order."""
    c = table(spark, sf, "customer")
    names = ["c_custkey", "c_name", "c_acctbal"]
    folder = new_path(spark, "mixed-headers")
    for i, order in enumerate((names, names[::-1])):
        c.filter(F.col("c_custkey") % 2 == i).select(*order).write.option("header", True).csv(f"{folder}/{i}")
    return tables.read_csv(spark, folder).select(*names)


def scan_csv_quoted_breaks(spark, sf):
    c = table(spark, sf, "customer")
    folder = new_path(spark, "breaks")
    note = F.concat("c_name", F.lit("\n"), "c_mktsegment")
    c.select("c_custkey", note.alias("note")).write.options(header=True, escape='"').csv(folder)
    return tables.read_csv(spark, folder)


def scan_csv_late_bytes(spark, sf):
    """Bytes that are not UTF-8 stand in every eleventh row only."""
    c = table(spark, sf, "customer")
    folder = new_path(spark, "late")
    name = F.when(F.col("c_custkey") % 11 == 0, F.concat("c_name", F.lit(" né"))).otherwise(F.col("c_name"))
    c.select("c_custkey", name.alias("c_name")).coalesce(1).write.options(header=True, encoding="ISO-8859-1").csv(folder)
    return tables.read_csv(spark, folder)


def scan_json_mixed_object(spark, sf):
    folder = made_files.json_mixed(table(spark, sf, "customer"), "c_custkey", ["c_custkey", "c_name"])
    return tables.load_table(spark, f"{folder}/*", "json").select("batch", "c_custkey", "c_name")


def scan_jsonl_count(spark, sf):
    folder = made_files.json_lines_with_damage(table(spark, sf, "customer"), "c_custkey")
    good = tables.load_table(spark, folder, "jsonl").agg(F.count("*").alias("n_rows"))
    bad = tables.corrupt_lines(spark, folder).filter("line_number > 0").agg(F.count("*").alias("n_bad"))
    return good.crossJoin(bad)  # one row each


def read_protect_codes(spark, sf):
    path = new_path(spark, "codes-csv")
    d = dirty_orders(spark, sf).select("id", "phone", "whole_gap", "price_out", "city")
    tables.write_table(d, path, "csv")
    return tables.load_table(spark, path, "csv").select("id", "phone", "whole_gap", "price_out")


def infer_schema(spark, sf):
    path = new_path(spark, "dirty-csv")
    tables.write_table(dirty_orders(spark, sf), path, "csv")
    return _pairs(spark, tables.inferred_types(tables.read_csv_text(spark, path)), "column string, type string")


def scan_excel_dir(spark, sf):
    books = made_files.workbooks(table(spark, sf, "customer"), "c_custkey")
    return tables.infer_types(workbook.workbook_rows(books))


def scan_json(spark, sf):
    folder = made_files.json_documents(table(spark, sf, "customer"), "c_custkey", columnar=False)
    return tables.load_table(spark, folder, "json").select("c_custkey", "c_name", "c_acctbal")


def json_columnar_to_rows(spark, sf):
    folder = made_files.json_documents(table(spark, sf, "customer"), "c_custkey", columnar=True)
    return tables.load_table(spark, folder, "json").select("c_custkey", "c_name", "c_acctbal")


def scan_jsonl_skip_corrupt(spark, sf):
    folder = made_files.json_lines_with_damage(table(spark, sf, "customer"), "c_custkey")
    return tables.load_table(spark, folder, "jsonl").select("c_custkey", "c_name", "c_acctbal")


def corrupt_json_lines(spark, sf):
    folder = made_files.json_lines_with_damage(table(spark, sf, "customer"), "c_custkey")
    return tables.corrupt_lines(spark, folder).agg(F.count("*").alias("n_corrupt"))


def nested_to_json(spark, sf):
    nation = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("nations"),
        F.array_sort(F.collect_list("n_nationkey")).alias("keys"),
    )
    region = table(spark, sf, "region").select(
        "r_regionkey", F.create_map("r_name", "r_regionkey").alias("named"),
        F.struct(F.col("r_name").alias("a"), F.lit(None).cast("int").alias("b")).alias("pair"),
    )
    return tables.nested_to_json(region.join(nation, "r_regionkey"))


def nested_to_json_floats(spark, sf):
    return tables.nested_to_json(table(spark, sf, "embeddings"))


def sink_csv_roundtrip(spark, sf):
    path = new_path(spark, "customer-csv")
    tables.write_table(table(spark, sf, "customer"), path, "csv")
    return tables.load_table(spark, path, "csv")


# --- projections and filters ------------------------------------------------------------


def drop_empty_columns(spark, sf):
    return missing.drop_near_empty_columns(dirty_orders(spark, sf))[0]


def select_numeric_columns(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select(*schema.numeric_columns(customer))


def significant_values(spark, sf):
    found = counts.text_metrics(
        dirty_orders(spark, sf), TEXTS, {"n": lambda v: count_where(text.is_significant(text.strip(v)))}
    )
    return _pairs(spark, {c: m["n"] for c, m in found.items()}, "column string, n_significant long")


def problem_rows(spark, sf):
    return missing.problem_rows(dirty_orders(spark, sf), ["id"])


def outlier_rows(spark, sf):
    return outliers.outlier_rows(dirty_orders(spark, sf).select("id", "price_out"), "price_out")


def preview(spark, sf):
    return profile(table(spark, sf, "orders"), "o_orderkey").preview(10)


def complete_cases(spark, sf):
    return missing.complete_rows(dirty_orders(spark, sf), ["id", "whole_gap", "price_out"])


# --- scalar readings --------------------------------------------------------------------


def clean_whitespace(spark, sf):
    return whitespace.clean_whitespace(dirty_orders(spark, sf))[0]


def leading_zero_columns(spark, sf):
    found = typing.code_columns(dirty_orders(spark, sf))
    return _pairs(spark, found, "column string, has_codes boolean")


def _scalar(spark, sf, **exprs):
    d = dirty_orders(spark, sf)
    return d.select("id", *[e(text.strip(F.col(c))).alias(c) for c, e in exprs.items()])


def parse_grades(spark, sf):
    return _scalar(spark, sf, note_txt=lambda v: numbers.grade_value(v, 5.0),
                   note20_txt=lambda v: numbers.grade_value(v, 20.0))


def parse_percent(spark, sf):
    return _scalar(spark, sf, rate_txt=numbers.percent_value)


def parse_amount(spark, sf):
    return _scalar(spark, sf, amount_txt=numbers.amount_value, amount_early=numbers.amount_value)


def try_numeric(spark, sf):
    return _scalar(spark, sf, note_txt=numbers.try_number, phone=numbers.try_number)


def parse_mixed_dates(spark, sf):
    return _scalar(spark, sf, date_txt=dates.to_timestamp)


def normalize_case(spark, sf):
    return case.normalize_case(dirty_orders(spark, sf), order_by="id")[0].select("id", "ref", "city", "prio_gap")


def identifier_like_columns(spark, sf):
    codes = typing.sample_codes(dirty_orders(spark, sf), TEXTS, "id")
    found = {c: any(v & typing.SHORT_CODE for v in codes[c][:10]) for c in TEXTS}
    return _pairs(spark, found, "column string, is_code_like boolean")


def estimate_numeric(spark, sf):
    d = outliers.estimated(dirty_orders(spark, sf), ["amount_txt"])
    return d.filter("amount_txt is not null")


# --- type decisions ---------------------------------------------------------------------


def normalize_case_full(spark, sf):
    out, _ = case.normalize_case(dirty_orders(spark, sf), full_scan=True)
    return out.select("id", "ref", "city", "prio_gap")


def numeric_candidates_full(spark, sf):
    return _names(spark, typing.numeric_candidates(dirty_orders(spark, sf), full_scan=True))


def numeric_candidates(spark, sf):
    return _names(spark, typing.numeric_candidates(dirty_orders(spark, sf), order_by="id"))


def dominant_scale(spark, sf):
    return typing.dominant_scales(dirty_orders(spark, sf), ["note_txt", "note20_txt"])


def rescaled_grades(spark, sf):
    d = dirty_orders(spark, sf)
    _, plans = typing.clean_types(d, "id", ["note_txt", "note20_txt"])
    return _joined(typing.rescaled_grades(d, plans, "id"))


def convert_numeric(spark, sf):
    d = dirty_orders(spark, sf)
    names = ["amount_txt", "amount_early", "note_txt", "note20_txt", "rate_txt"]
    return _doubles(typing.clean_types(d, "id", names)[0].select("id", *names))


def convert_dates(spark, sf):
    return typing.clean_types(dirty_orders(spark, sf), "id", ["date_txt", "phone"])[0].select("id", "date_txt", "phone")


def clean_types(spark, sf):
    d = _stored(spark, sf)
    return _doubles(typing.clean_types(d, "id", values=typing.repeated_values(d, TEXTS, "id"))[0])


def clean_types_full(spark, sf):
    """Shares of all values decide, at 0.95: a column with more oddities keeps its text."""
    d = _stored(spark, sf)
    return _doubles(typing.clean_types(d, "id", rate=0.95, values=typing.repeated_values(d, TEXTS, "id"))[0])


def recover_integers(spark, sf):
    return typing.recover_integers(table(spark, sf, "lineitem"))[0].select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount"
    )


def unparsed_values(spark, sf):
    d = dirty_orders(spark, sf)
    _, plans = typing.clean_types(d, "id", ["amount_txt", "date_txt", "rate_txt"])
    return _joined(typing.unparsed_values(d, plans, "id"))


def mistyped_columns(spark, sf):
    return _pairs(spark, typing.mistyped_columns(dirty_orders(spark, sf), "id"), "column string, reads_as string")


# --- profiling --------------------------------------------------------------------------


def profile_shape(spark, sf):
    return profile(table(spark, sf, "orders")).shape


def profile_missing(spark, sf):
    return profile(dirty_orders(spark, sf)).missing_values


def missing_summary(spark, sf):
    return missing.missing_summary(dirty_orders(spark, sf))


def duplicate_count(spark, sf):
    return duplicates.duplicate_count(dirty_orders(spark, sf))


def row_quality(spark, sf):
    return missing.row_quality(dirty_orders(spark, sf))


def row_alerts(spark, sf):
    alerts = missing.row_alerts(dirty_orders(spark, sf), "id")
    return alerts.withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


def describe_numeric(spark, sf):
    return rounded(describe.describe_numeric(table(spark, sf, "lineitem")), 4)


def profile_outliers(spark, sf):
    found = [
        outliers.profile_outliers(df)
        for df in (table(spark, sf, "events"), table(spark, sf, "orders"), dirty_orders(spark, sf))
    ]
    return rounded(reduce(DataFrame.unionByName, found))


def iqr_bounds(spark, sf):
    rows = []
    for name in ("orders", "events", "lineitem"):
        rows += [(c, *b) for c, b in outliers.iqr_bounds(table(spark, sf, name)).items()]
    return rounded(small_table(spark, rows, "column string, low double, high double"))


def count_outliers_k3(spark, sf):
    found = outliers.outlier_counts(table(spark, sf, "events"), factor=3.0)
    return _pairs(spark, found, "column string, n_outliers long")


def outlier_summary(spark, sf):
    d = dirty_orders(spark, sf)
    return outliers.outlier_summary(d, typing.numeric_candidates(d, order_by="id"))


def profile_categorical(spark, sf):
    parts = [
        counts.categorical_profile(counts.key_counts(df))
        for df in (table(spark, sf, "orders"), table(spark, sf, "part"), dirty_orders(spark, sf))
    ]
    return reduce(DataFrame.unionByName, parts)


def top_categories(spark, sf):
    return frequent.top_values_of(table(spark, sf, "part"))


def top_categories_texts(spark, sf):
    """Columns of few and of many values, of short and of long ones."""
    found = [frequent.top_values_of(table(spark, sf, t)).withColumn("source", F.lit(t)) for t in ("documents", "conversations")]
    return found[0].unionByName(found[1])


def frequency_skew(spark, sf):
    return counts.categorical_profile(counts.key_counts(table(spark, sf, "documents"))).select(
        "column", "skewness_frequency", "is_high_skewness"
    )


def format_anomalies(spark, sf):
    return counts.format_anomalies(dirty_orders(spark, sf))


def case_targets(spark, sf):
    return counts.case_targets(counts.format_anomalies(dirty_orders(spark, sf)))


def identifier_columns(spark, sf):
    parts = [counts.identifier_columns(table(spark, sf, t)) for t in ("customer", "part", "documents")]
    return reduce(DataFrame.unionByName, parts)


def column_overview(spark, sf):
    return counts.column_overview(table(spark, sf, "orders"))


def correlation_matrix(spark, sf):
    return rounded(correlation.correlation_matrix(spread(table(spark, sf, "lineitem"))), 6)


def histogram_20(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "orders"), "o_totalprice"))


def histogram_auto(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "events"), "value", None))


def kde_grid(spark, sf):
    return rounded(charts.density(spread(table(spark, sf, "events")), "value"), 6)


def boxplot_stats(spark, sf):
    parts = [charts.box_stats(table(spark, sf, t)) for t in ("orders", "events")]
    return rounded(reduce(DataFrame.unionByName, parts))


def top_n_bar(spark, sf):
    return charts.top_bars(table(spark, sf, "events"), "event_type")


def scatter_sample(spark, sf):
    d = dirty_orders(spark, sf).dropDuplicates(["id"])
    return charts.scatter_sample(d, "id", 500, ["whole_gap", "price_out"])


def profile_distinct_sketch(spark, sf):
    """Yearly sketches of `orders`, united: whether each estimate is within its bound."""
    orders = table(spark, sf, "orders")
    parts = materialised(counts.distinct_sketches(orders, by=F.year("o_orderdate")), "sketches")
    exact = counts.column_overview(orders).select("column", "n_distinct")
    off = F.abs(F.col("n_distinct_estimate") - F.col("n_distinct")) / F.col("n_distinct")
    return counts.united_sketches(parts).join(exact, "column").select(
        "column", "n_present", "n_distinct", (off <= counts.sketch_bound()).alias("within_bound")
    )


def scatter_points(spark, sf):
    return charts.scatter_points(table(spark, sf, "lineitem"))


# --- cleaning ---------------------------------------------------------------------------


def drop_duplicates(spark, sf):
    return duplicates.drop_duplicates(dirty_orders(spark, sf))[0]


def clip_outliers(spark, sf):
    out, _ = outliers.clip_outliers(dirty_orders(spark, sf))
    return rounded(out.select("id", "whole_gap", "price_out"))


def clip_outliers_per_column(spark, sf):
    out, _ = outliers.clip_outliers(table(spark, sf, "events"), ["value", "absent"], {"value": 0.5})
    return rounded(out.select("event_id", "user_id", "value"))


def fill_missing(spark, sf):
    out, _ = fill.fill_missing(dirty_orders(spark, sf))
    return rounded(out)


def _stored(spark, sf):
    """The dirty view as a stored table, which is what a cleaning run starts from."""
    return materialised(dirty_orders(spark, sf), "dirty")


def _cleaned(spark, sf):
    return fit_cleaning(_stored(spark, sf), ALL)


def cleaned_table(spark, sf):
    return rounded(_doubles(_cleaned(spark, sf).table))


def cleaned_table_full(spark, sf):
    options = CleaningOptions(full_scan=True, full_scan_rate=0.95, order_by="id")
    return rounded(_doubles(fit_cleaning(_stored(spark, sf), options).table))


def reapplied_plan(spark, sf):
    d = _stored(spark, sf)
    plan = fit_cleaning(d, CleaningOptions(order_by="id")).plan
    kept = ("id", "amount_txt", "date_txt", "note_txt", "note20_txt", "rate_txt", "city", "whole_gap")
    return _doubles(plan.typed(d).select(*kept))


def cleaning_totals(spark, sf):
    return audit.step_totals(audit.audit_table(_cleaned(spark, sf), examples=0)).select("step", "unit", "total")


def audit_summary(spark, sf):
    return audit.audit_summary(_cleaned(spark, sf))


def audit_table(spark, sf):
    return _joined(audit.audit_table(_cleaned(spark, sf)).drop("pass"))


def step_totals(spark, sf):
    d = _stored(spark, sf)
    return audit.step_totals(audit.audit_table(fit_cleaning(d, CleaningOptions(order_by="id")), examples=0))


def type_changes(spark, sf):
    return audit.type_changes(_cleaned(spark, sf).plan, spark)


def global_metrics(spark, sf):
    return audit.global_metrics(dirty_orders(spark, sf))


def before_after_delta(spark, sf):
    d = _stored(spark, sf)
    return audit.before_after(d, fit_cleaning(d, CleaningOptions(order_by="id")).table)


def report_history(spark, sf):
    """Missing values of the dirty and of the deduplicated view as two runs; the second run is
    first written with the wrong table, then again."""
    d, folder = dirty_orders(spark, sf), new_path(spark, "reports")
    early, late = audit.run_stamp(datetime(2026, 3, 1)), audit.run_stamp(datetime(2026, 3, 2))
    profiled = {"missing": missing.null_profile(d)}
    reports.write_reports(profiled, folder, early)
    reports.write_reports(profiled, folder, late)
    kept = duplicates.drop_duplicates(d)[0].drop("mostly_null").withColumn("copies", F.lit(1))
    reports.write_reports({"missing": missing.null_profile(kept)}, folder, late)
    return reports.compared_runs(spark, folder, "missing", early, late, ["column"])


def control_verdict(spark, sf):
    return audit.control(_cleaned(spark, sf).table, "id")


_FUNCTIONS = (
    scan_parquet, scan_csv, scan_csv_ragged, scan_csv_losses, scan_csv_mixed_headers, scan_csv_quoted_breaks, scan_csv_late_bytes,
    scan_json_mixed_object, scan_jsonl_count, nested_to_json_floats, histogram_auto, detect_dialect, sniff_format, read_protect_codes, infer_schema,
    scan_excel_dir, scan_json, json_columnar_to_rows, scan_jsonl_skip_corrupt, corrupt_json_lines,
    nested_to_json, sink_csv_roundtrip, drop_empty_columns, select_numeric_columns,
    significant_values, problem_rows, outlier_rows, preview, complete_cases, clean_whitespace,
    leading_zero_columns, parse_grades, parse_percent, parse_amount, try_numeric,
    parse_mixed_dates, normalize_case, identifier_like_columns, estimate_numeric,
    numeric_candidates, numeric_candidates_full, normalize_case_full, dominant_scale, rescaled_grades, convert_numeric, convert_dates,
    clean_types, clean_types_full, recover_integers, unparsed_values, mistyped_columns, profile_shape,
    profile_missing, missing_summary, duplicate_count, row_quality, row_alerts, describe_numeric,
    profile_outliers, iqr_bounds, count_outliers_k3, outlier_summary, profile_categorical,
    top_categories, top_categories_texts, frequency_skew, format_anomalies, case_targets, identifier_columns,
    column_overview, correlation_matrix, histogram_20, kde_grid, boxplot_stats, top_n_bar,
    scatter_points, scatter_sample, profile_distinct_sketch, drop_duplicates, clip_outliers, clip_outliers_per_column, fill_missing,
    cleaned_table, cleaned_table_full, reapplied_plan, cleaning_totals, audit_summary, audit_table, step_totals,
    type_changes, global_metrics, before_after_delta, control_verdict, report_history,
)


def _tuned(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(tune(spark), folder)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _tuned(f) for f in _FUNCTIONS}

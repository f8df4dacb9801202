import pytest
from pyspark.sql import functions as F

from limpid import CleaningOptions, CleaningPlan, audit_table, clean, control, decide, fit_cleaning
from limpid.catalog.dirty_orders import dirty_orders
from limpid.functions.text import is_significant, squeeze_whitespace, strip
from limpid.plans import audit
from limpid.storage import materialised

BOTH = CleaningOptions(correct_outliers=True, fill_missing=True, order_by="id")


@pytest.fixture(scope="module")
def dirty(spark, tables):
    return materialised(dirty_orders(spark, tables), "dirty")


@pytest.fixture(scope="module")
def run(dirty):
    return fit_cleaning(dirty, BOTH)


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_no_silent_loss(dirty):
    """Present values that went missing are exactly the declared ones."""
    result = fit_cleaning(dirty, CleaningOptions(order_by="id"))
    typed = result.plan.typed(dirty)
    for c, p in result.plan.passes[0].conversions.items():
        before = dirty.filter(is_significant(strip(F.col(c)))).count()
        after = typed.filter(F.col(c).isNotNull()).count()
        assert before - after == p.n_lost


def test_no_convertible_text_is_left(run):
    assert control(run.table, "id").filter("not well_typed").count() == 0


def test_codes_and_identifiers_stay_text(run):
    types = dict(run.table.dtypes)
    assert {types[c] for c in ("ref", "phone", "amount_early", "city", "prio_gap")} == {"string"}
    assert "mostly_null" not in types


def test_result_has_no_gaps_duplicates_or_outliers_asked_about(run):
    m = audit.table_metrics(run.table)
    assert m["n_missing"] == 0
    assert run.table.count() == run.table.distinct().count() == run.plan.rows_after


def test_partitioning_does_not_matter(dirty, run):
    want = rows(run.table)
    for n in (1, 4, 17):
        assert rows(fit_cleaning(dirty.repartition(n, F.rand(n)), BOTH).table) == want


def test_second_run_changes_nothing(run):
    again = fit_cleaning(run.table, CleaningOptions(fill_missing=True, order_by="id"))
    assert not any(p.changes for p in again.plan.passes)
    assert again.plan.fills == {} and rows(again.table) == rows(run.table)


def test_plan_survives_json_and_applies_again(dirty, run):
    plan = CleaningPlan.from_json(run.plan.to_json())
    assert rows(plan.apply(dirty)) == rows(run.table)
    few = dirty.filter("id < 50")
    assert plan.typed(few).schema == run.plan.typed(dirty).schema


def test_plan_applies_to_a_stream(spark, dirty, run, tmp_path):
    """The typed projection holds no state, so it needs no streaming form of its own."""
    path = str(tmp_path / "in")
    dirty.limit(40).write.parquet(path)
    stream = spark.readStream.schema(dirty.schema).parquet(path)
    query = run.plan.typed(stream).writeStream.format("memory").queryName("typed").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("typed").count() == 40


def test_nothing_is_filled_or_clipped_without_consent(dirty):
    result = fit_cleaning(dirty, CleaningOptions(order_by="id"))
    assert result.plan.fills == {} and result.plan.clips == {}
    ignored = audit_table(result).filter("metric = 'ignored'")
    assert {r["step"] for r in ignored.collect()} == {"missing_filled", "outliers_corrected"}
    assert decide(None) is False and decide(True) is True and decide(False, default=True) is False


def test_chosen_columns_and_thresholds(dirty):
    options = CleaningOptions(
        correct_outliers=True, fill_missing=True, missing_columns=["prio_gap", "absent"],
        outlier_columns=["price_out"], outlier_thresholds={"price_out": 100.0}, order_by="id",
    )
    plan = fit_cleaning(dirty, options).plan
    assert set(plan.fills) == {"prio_gap"} and plan.clips == {}


def test_scan_order_when_no_column_orders_rows(spark):
    rows_ = [(str(i), "Lille") for i in range(30)] + [("0", "Lille"), ("1", "lille")]
    df = spark.createDataFrame(rows_, "k string, city string")
    result = fit_cleaning(df)
    assert result.table.columns == ["k", "city"] and result.table.count() == 30
    assert dict(result.table.dtypes) == {"k": "bigint", "city": "string"}


def test_duplicates_may_reopen_a_decision(spark):
    """Copies hide the date rate; once they are gone the column converts, in a later pass."""
    good = [(i, f"0{i % 9 + 1}/02/20{10 + i}") for i in range(20)]
    bad = [(99, "bad date")] * 10
    df = spark.createDataFrame(good + bad, "n long, d string")
    result = fit_cleaning(df, CleaningOptions(order_by="n"))
    assert [list(p.conversions) for p in result.plan.passes[:2]] == [[], ["d"]]
    assert dict(result.table.dtypes)["d"] == "timestamp_ntz"
    found = audit_table(result).filter("step = 'values_unparsed'").first()
    assert found["pass"] == 2 and found["examples"] == ["bad date"]


def test_perfect_and_empty_tables(spark):
    perfect = spark.createDataFrame([(1, "ana"), (2, "bob")], "id long, name string")
    result = fit_cleaning(perfect, CleaningOptions(True, True))
    assert rows(result.table) == rows(perfect) and not any(p.changes for p in result.plan.passes)
    empty = fit_cleaning(spark.createDataFrame([], "id long, name string"), CleaningOptions(True, True))
    assert empty.table.count() == 0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (2.5,)], "x double")
    assert sorted(r[0] for r in clean(df, fill_missing=True).collect()) == [1.5, 2.0, 2.5]


def test_audit_accounts_for_every_step(run):
    table = audit_table(run, "20260101_000000").collect()
    steps = {(r["step"], r["column"]): r for r in table}
    assert steps[("values_unparsed", "date_txt")]["examples"] == ["0197-08-14"]
    assert steps[("grades_rescaled", "note20_txt")]["examples"] == ["4/5 → 16"]
    assert {r["run_id"] for r in table} == {"20260101_000000"}
    totals = {r["step"]: r["total"] for r in audit.step_totals(audit_table(run)).collect()}
    assert totals["types_converted"] == 5 and totals["duplicates_removed"] == 38


def test_run_stamp_orders_runs():
    from datetime import datetime

    assert audit.run_stamp(datetime(2026, 9, 29, 14, 32, 7)) == "20260929_143207"


def test_whitespace_counts_only_real_changes(spark):
    df = spark.createDataFrame([(1, " a"), (2, None), (3, "b"), (4, "c  d")], "n long, v string")
    p = fit_cleaning(df, CleaningOptions(order_by="n")).plan.passes[0]
    assert p.whitespace == {"v": 2}
    assert df.select(squeeze_whitespace(F.col("v"))).filter("1=1").count() == 4


def test_a_pass_scans_once_to_decide_and_once_to_write(spark):
    """Grades and losses included: scale, whole numbers and examples come from those two."""
    rows = [(i, f"{i % 9}/10" if i % 2 else f"{i % 5},5/5", f" a  {i}", str(i + 1)) for i in range(400)]
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "n long, g string, t string, w string")
    result = fit_cleaning(df.mapInArrow(run, df.schema), CleaningOptions(order_by="n"))
    assert seen.value == 2 * len(rows)
    conversions = result.plan.passes[0].conversions
    assert (conversions["g"].kind, conversions["g"].scale, conversions["g"].n_rescaled) == ("bigint", 10.0, 200)
    table = {(r["step"], r["column"]): r for r in audit_table(result).collect()}
    assert table["grades_rescaled", "g"]["examples"][:2] == ["0,5/5 → 1", "2,5/5 → 5"]
    assert seen.value == 2 * len(rows)


def test_whole_grades_become_integers_when_written(spark):
    df = spark.createDataFrame([(i, f"{i % 5}/5" if i % 3 else f"{2 * (i % 5)}/10") for i in range(90)], "n long, g string")
    result = fit_cleaning(df, CleaningOptions(order_by="n"))
    assert result.plan.passes[0].conversions["g"].kind == "bigint" == dict(result.table.dtypes)["g"]
    again = result.plan.apply(df, deduplicate=False)
    assert rows(again) == rows(result.table)


def test_losses_are_written_beside_the_typed_table(spark):
    lost = ["odd", "", "n/a", "odd", "even"]
    values = [str(i) for i in range(1, 200)] + lost
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n long, v string")
    result = fit_cleaning(df, CleaningOptions(order_by="n"))
    (cells,) = [c for c in result.changed if c is not None]
    assert [(r["at"], r["value"]) for r in cells.orderBy("at").collect()] == [(199, "odd"), (202, "odd"), (203, "even")]
    assert result.plan.passes[0].conversions["v"].n_lost == 3
    assert [c for c in result.table.columns if c.startswith("__")] == []


def test_shares_of_all_values_decide_a_run(spark):
    values = [("odd", "AB1")] * 3 + [(str(i), "Word") for i in range(1, 98)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "n long, v string, t string")
    sampled = fit_cleaning(df, CleaningOptions(order_by="n")).plan.passes[0]
    shared = fit_cleaning(df, CleaningOptions(order_by="n", full_scan=True)).plan.passes[0]
    assert (sampled.conversions, sampled.lowered) == ({}, {})
    assert shared.conversions["v"].kind == "bigint" and set(shared.lowered) == {"t"}
    assert fit_cleaning(df, CleaningOptions(full_scan=True, full_scan_rate=0.98)).plan.passes[0].conversions == {}

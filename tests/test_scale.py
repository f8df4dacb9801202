"""Scans whose tasks and cost follow the rows."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from limpid import constants as K, storage
from limpid.functions import dates
from limpid.functions.numbers import looks_numeric
from limpid.functions.text import (
    changes_when_lowered, has_ascii_letter, has_special_space, is_short_code, squeeze_whitespace, strip,
)
from limpid.operators import counts, typing
from limpid.operators.aggregate import count_where
from limpid.plans import cleaning
from limpid.session import tune


def test_packed_file_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    spark.range(1000).coalesce(3).write.parquet(str(tmp_path / "packed"))
    df = spark.read.parquet(str(tmp_path / "packed"))
    out = storage.spread(df)
    assert out.rdd.getNumPartitions() == 10
    assert sorted(r.id for r in out.collect()) == list(range(1000))


def test_month_first_with_short_year(column):
    """A rewrite met the next one's pattern, which read the year as the day."""
    df = column(["12/25/97", "12/13/20", "25/12/97"]).orderBy("n")
    read = [r.v for r in df.select(dates.to_timestamp(F.col("v")).alias("v")).collect()]
    assert read == [datetime(1997, 12, 25), datetime(2020, 12, 13), datetime(1997, 12, 25)]


def test_first_looks_change_no_text(column):
    """Amounts and accents pass the first look; all white space still meets the full pattern."""
    odd = ["1 234,50 €", "é è", "", " ", "a\tb", "a\x1cb ", " 12,5 €", "a  b", "x　", "£5\u0085", "a  b", "\x01a"]
    df = column(odd)
    found = df.select("v", squeeze_whitespace(F.col("v")).alias("s"), strip(F.col("v")).alias("t"), has_special_space(F.col("v")).alias("k")).collect()
    other = set(K.WS_CHARS) - {" "}
    for r in found:
        assert r.s == re.sub(f"[{K.WS_CHARS}]{{2,}}|[{''.join(sorted(other))}]", " ", r.v).strip(" ")
        assert r.t == r.v.strip(K.WS_CHARS)
        assert r.k or not other & set(r.v)
    assert not next(r.k for r in found if r.v == "1 234,50 €")


def test_lettered_numbers_keep_their_marks(column):
    """Tests skipped on cells of number characters give what they give on every cell."""
    odd = ["1e5", "1E5", "12;5", ";", "", "5 €", "a1", "12.5", "€", "e", "4/5", "1é", "٣a", "12/05/20", "1/1/97", "97-1-1", "n/a"]
    got = typing.read_columns(column(odd), ["v"], "n")["v"]
    v = F.col("v")
    one = column(odd).select(
        count_where(~looks_numeric(v)).alias("other"), count_where(is_short_code(v)).alias("short"),
        count_where(has_ascii_letter(v)).alias("letter"), count_where(changes_when_lowered(v)).alias("case"),
    ).first()
    assert {n: got[n] for n in one.asDict()} == one.asDict()
    assert got["dates"] == 3


def test_second_pass_reads_only_new_text(spark, monkeypatch):
    """Readings of text that a pass left alone stand, less those of the copies that went away."""
    rows = [(i, f"code {i % 7}", "Ab" if i % 3 else "ab", f"{i % 11},5 €" if i % 2 else "dear", None if i % 5 else f"{i}x") for i in range(300)]
    df = spark.createDataFrame(rows + rows[::4] + rows[:9], "id long, same string, case string, mixed string, gap string")
    read, taken, asked = typing.read_columns, [], []

    def reading(table, columns, *args, **options):
        taken.append((list(columns), "weight" in options))
        return read(table, columns, *args, **options)

    fit = cleaning.fit_pass

    def fitting(table, options, known=None):
        if known:
            fresh = read(table, list(known), "id", squeeze=True)
            asked.append({c: (dict(r.counts), dict(r.first)) == (dict(fresh[c].counts), dict(fresh[c].first)) for c, r in known.items()})
        return fit(table, options, known)

    monkeypatch.setattr(cleaning, "read_columns", reading)
    monkeypatch.setattr(cleaning, "fit_pass", fitting)
    run = cleaning.fit_cleaning(df, cleaning.CleaningOptions(order_by="id"))
    assert run.plan.rows_after == 300
    assert taken[0][0] == ["same", "case", "mixed", "gap"] and taken[1][0] == ["case"]
    assert asked == [{"same": True, "mixed": True, "gap": True}]


def test_format_anomalies_group_only_mixed_columns(spark, monkeypatch):
    """Values are grouped only of columns where their case can matter."""
    rows = [(f"R{i}", "Lille" if i % 2 else "LILLE", "ab " if i == 3 else "ab", f"One {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "ref string, city string, edge string, single string")
    grouped = []
    unpivoted = counts.unpivoted
    monkeypatch.setattr(counts, "unpivoted", lambda df, columns: grouped.append(list(columns)) or unpivoted(df, columns))
    found = {r["column"]: (r["space_anomaly"], r["case_anomaly"]) for r in counts.format_anomalies(df).collect()}
    assert found == {"ref": (False, False), "city": (True, True), "edge": (True, False), "single": (False, False)}
    assert [sorted(c) for c in grouped[1:]] == [["city", "single"]]


def test_repeated_values_are_read_once(spark):
    """Columns that repeat their values are read by value, with the readings of a cell-by-cell scan."""
    shown = ["4/5", " 12,5 %", "12/05/97", "1e5", "X9", "word", None, "0612", "1 234,50 €", "€ 5", "13-01-1999"]
    rows = [(i if i % 13 else None, shown[i % 11], shown[i * i % 7], f"{i} €") for i in range(400)]
    df = spark.createDataFrame(rows, "n long, a string, b string, single string").repartition(3)
    names = ["a", "b", "single"]
    assert typing.repetitive_columns(df, names) == ["a", "b"]
    by_cell = typing.read_columns(df, names, "n", squeeze=True)
    for repeated in (["a", "b"], names):
        assert typing.read_columns(df, names, "n", squeeze=True, repeated=repeated) == by_cell


def test_repeated_values_are_converted_once(spark, monkeypatch):
    """Columns that repeat their values are converted by value, with the result and the losses of cell by cell."""
    shown = ["4/5", "2/10", "3", None, "7/10", "odd ", "", "4/5", "n/a", " 1"] * 10 + ["5", "4/5"] * 60
    days = ["12/05/1997", "1999-02-03", None, "13-01-99"] * 5 + ["0197-08-14"]
    rows = [(i, shown[i % 220] if i > 150 else "4/5", days[i % 21], f"{i % 40},5 €", f"{i} €") for i in range(660)]
    df = spark.createDataFrame(rows + rows[:30], "n long, grade string, day string, money string, single string").repartition(3)

    def run():
        result = cleaning.fit_cleaning(df, cleaning.CleaningOptions(order_by="n"))
        lost = sorted(tuple(r) for cells in result.changed if cells is not None for r in cells.collect())
        types = typing.clean_types(df, "n", values=typing.repeated_values(df, df.columns[1:], "n"))
        return [sorted(map(str, t.collect())) for t in (result.table, types[0])], result.table.dtypes, result.plan.to_json(), types[1], lost

    looked_up = []
    of_values = typing.Values.looked_up
    monkeypatch.setattr(
        typing.Values, "looked_up", lambda self, df, plans, *args: looked_up.append(set(plans)) or of_values(self, df, plans, *args)
    )
    by_value = run()
    assert looked_up == [{"grade", "day", "money"}] * 2
    assert len(by_value[-1]) > 50
    monkeypatch.setattr(typing, "MAPPED_VALUES", 0)
    assert run() == by_value
    assert len(looked_up) == 2


def test_control_reads_repeated_values_once(spark, monkeypatch):
    """What still reads as a number or date is told of repeated values, not of every cell."""
    rows = [(i, f"{i % 9},5 €", f"0{i % 9 + 1}/03/0197", "word", f"R{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "n long, money string, day string, same string, single string")
    read, known = typing.read_columns, []
    monkeypatch.setattr(typing, "read_columns", lambda *args, **options: known.append(options.get("values")) or read(*args, **options))
    assert typing.mistyped_columns(df, "n") == {"money": "number", "day": "date"}
    assert set(known[0].columns) == {"money", "day", "same"} and known[0].table.count() == 19


def test_a_scan_has_pieces_for_every_core(spark, tmp_path):
    """Files of a stored table are read in more tasks than there are cores, so none waits for a last long one."""
    tune(spark).range(2_000_000).selectExpr("id", "uuid() u").repartition(24).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_scan_order_counts_rows(spark):
    """Without an order column, the odd value of row 60 is among the first 100, however many columns there are."""
    rows = [("odd" if i == 60 else str(i), "x", str(i), "y") for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").coalesce(1)
    assert list(typing.clean_types(df)[1]) == ["c"]

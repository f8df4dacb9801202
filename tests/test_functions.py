from datetime import datetime

import pytest
from pyspark.sql import functions as F

from limpid.functions import dates, numbers, text


def values(df, expr):
    return [r[0] for r in df.orderBy("n").select(expr).collect()]


def test_squeeze_every_kind_of_space(column):
    df = column(["  a  b ", "a  b", "\tx\n", "clean", "é  é", "a　b", "", None, "a\x1cb"])
    assert values(df, text.squeeze_whitespace(F.col("v"))) == [
        "a b", "a b", "x", "clean", "é é", "a b", "", None, "a b",
    ]


def test_strip_keeps_inner_space(column):
    df = column([" a  b ", " x ", "y\t", None])
    assert values(df, text.strip(F.col("v"))) == ["a  b", "x", "y", None]


def test_codes(column):
    codes = ["0612345678", "01000", "06 12 34 56 78", "007", "+0123", "06 12"]
    not_codes = ["0", "0.5", "0,25", "-0.5", "01/02/2024", "0197-08-14T00:00:00", "12", ""]
    df = column(codes + not_codes)
    assert values(df, text.is_code(text.strip(F.col("v")))) == [True] * len(codes) + [False] * len(not_codes)


def test_missing_markers(column):
    df = column(["", " ", "NaN", "None", "null", "NA", "n/a", "-", "--", "0", "x", None])
    assert values(df, text.is_significant(text.strip(F.col("v")))) == [False] * 9 + [True, True, False]


def test_lower_guarded(column):
    df = column(["Paris", "PARIS", "NaN", "NULL", "75001", "É", "paris", None])
    assert values(df, text.lower_guarded(F.col("v"))) == ["paris", "paris", "NaN", "NULL", "75001", "É", "paris", None]


@pytest.mark.parametrize(
    "written, read",
    [
        ("7 340,18 €", 7340.18), ("7\u00a0340,18 €", 7340.18), ("61\u202f209,4 €", 61209.4),
        ("£8.25", 8.25), ("$11", 11.0), ("26.000€", 26.0), ("4.605,75", 4605.75), ("4,605.75", 4605.75),
        ("3.871.002,6", 3871002.6), ("+8", 8.0), ("-6,25", -6.25), (".75", 0.75), ("9.", 9.0), ("2e4", 20000.0),
        ("6d", None), ("8f", None), ("word", None), ("", None), ("4,5,6", None), ("--9", None), ("13/16", 13.0),
        ("2,5/8", 2.5), ("7/0", 7.0), ("31.0625%", 31.0625), ("6,5 %", 6.5), ("0x2A", None), ("Q7781", None),
        ("4/5/6", None),
    ],
)
def test_to_double(column, written, read):
    assert values(column([written]), numbers.to_double(F.col("v"))) == [read]


def test_grades_on_a_scale(column):
    df = column(["13/16", "6/8", "9", "2/16", "5/0", "2,5/8"])
    assert values(df, numbers.to_double(F.col("v"), 16.0)) == [13.0, 12.0, 9.0, 2.0, 5.0, 5.0]
    assert values(df, numbers.is_rescaled_grade(F.col("v"), 16.0)) == [False, True, False, False, False, True]


def test_exponents_refused_next_to_marks(column):
    df = column(["1e5", "12", "50 %"])
    assert values(df, numbers.to_double(F.col("v"), exponents=False)) == [None, 12.0, 50.0]


def test_long_digit_strings_keep_every_digit(column):
    df = column(["1234567890123456789", "5.0", "1e2"])
    assert values(df, numbers.to_long(F.col("v"))) == [1234567890123456789, 5, 100]


def day(y, m, d, *time):
    return datetime(y, m, d, *time)


@pytest.mark.parametrize(
    "written, read",
    [
        ("2023-09-15 10:11:12", day(2023, 9, 15, 10, 11, 12)),
        ("13/09/2024 08:05:00", day(2024, 9, 13, 8, 5)),
        ("2023-09-15T10:11:12", day(2023, 9, 15, 10, 11, 12)),
        ("13/09/2024", day(2024, 9, 13)), ("2023-9-5", day(2023, 9, 5)), ("18-07-2023", day(2023, 7, 18)),
        ("2023/07/18", day(2023, 7, 18)), ("18.07.2023", day(2023, 7, 18)), ("03/04/24", day(2024, 4, 3)),
        ("03-04-68", day(2068, 4, 3)), ("03-04-69", day(1969, 4, 3)), ("03/25/2024", day(2024, 3, 25)),
        ("12 Jan 2024", day(2024, 1, 12)), ("september 3, 2024", day(2024, 9, 3)),
        ("2023-09-15T10:11:12Z", day(2023, 9, 15, 10, 11, 12)),
        ("31/02/2024", None), ("0197-08-14", None), ("01/01/1850", None), ("5/5", None), ("2024", None),
        ("2024-01", None), ("12,5", None), ("1.2.34", None), ("", None), ("99/99/9999", None),
        ("1900-01-01", day(1900, 1, 1)), ("2100-12-31", day(2100, 12, 31)), ("2101-01-01", None),
    ],
)
def test_dates(column, written, read):
    assert values(column([written]), dates.to_timestamp(F.col("v"))) == [read]


def test_any_year_when_unbounded(column):
    assert values(column(["01/01/1850"]), dates.to_timestamp(F.col("v"), bounded=False)) == [day(1850, 1, 1)]

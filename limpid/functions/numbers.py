"""Numeric readings of text: amounts, grades, percentages, plain numbers.

Spark's own cast reads ``1d`` or ``3f`` as numbers, so every cast sits behind a
strict pattern, and only ``try_cast`` is used. Each reading is one linear chain of
replacements: no step is referenced twice, which keeps generated code small on
wide tables. Text that does not match comes out NULL before any cast: casting an
empty text would raise and catch an exception per cell. All functions expect
trimmed text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from limpid import constants as K

# Thousands separators of a value that holds both marks: the last mark is decimal.
_THOUSANDS = r"\.(?=.*,[^.]*$)|,(?=.*\.[^,]*$)"


def looks_numeric(c: Column) -> Column:
    """The value could be a number: plain, money, grade or percentage. Blank passes."""
    return c.rlike(K.NUMERIC_LOOK_PATTERN)


def _group(c: Column, pattern: str, group: int) -> Column:
    """One group of an anchored pattern; NULL, not an empty text, where it does not match."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def _point(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def _unsigned(c: Column) -> Column:
    """Currency signs and thousands spaces out: plain replacements, which leave text without them as it is."""
    for sign in K.AMOUNT_NOISE[1:-1]:
        c = F.replace(c, F.lit(sign), F.lit(""))
    return c


def grade_numerator(c: Column) -> Column:
    """Numerator of a grade such as ``4,5/5``; NULL for anything else."""
    return _grade_part(c, 1)


def grade_denominator(c: Column) -> Column:
    return _grade_part(c, 2)


def is_rescaled_grade(c: Column, scale: float) -> Column:
    """A grade on another scale than its column's; a zero denominator has no scale."""
    return F.coalesce(~grade_denominator(c).isin(0.0, float(scale)), F.lit(False))


def _rescaled(c: Column, scale: float) -> Column:
    return F.round(grade_numerator(c) / grade_denominator(c) * F.lit(float(scale)), 6)


def grade_value(c: Column, scale: float | None = None) -> Column:
    """A grade expressed on `scale`; the numerator when it already is."""
    num = grade_numerator(c)
    if scale is None:
        return num
    return F.when(is_rescaled_grade(c, scale), _rescaled(c, scale)).otherwise(num)


def percent_value(c: Column) -> Column:
    """The displayed number of a percentage: ``1,5 %`` is 1.5, not 0.015."""
    return _point(_group(c, K.PERCENT_PATTERN, 1)).try_cast("double")


def decimal_point(c: Column) -> Column:
    """Make the decimal mark a point.

    A comma alone is a decimal mark, a point alone is left as it is. When a value
    holds both, the last one is the decimal mark and the other groups thousands.
    """
    return _point(F.regexp_replace(c, _THOUSANDS, ""))


def _grade_part(c: Column, group: int) -> Column:
    """A number of a grade; text without its mark never meets the pattern."""
    return F.when(c.contains("/"), _point(_group(c, K.GRADE_PATTERN, group)).try_cast("double"))


def amount_text(c: Column) -> Column:
    """Drop currency signs and thousands spaces, then unify the decimal mark."""
    return decimal_point(_unsigned(c))


def strict_number_text(c: Column) -> Column:
    """The text itself when it spells a number, else NULL."""
    return _group(c, K.NUMBER_PATTERN, 0)


def try_number(c: Column) -> Column:
    return strict_number_text(c).try_cast("double")


def amount_value(c: Column) -> Column:
    return try_number(amount_text(c))


def rough_number(c: Column) -> Column:
    """Quick estimate used before typing: signs out, every comma to a point."""
    return try_number(_point(_unsigned(c)))


def number_text(c: Column) -> Column:
    """Number text of a cell, NULL when it spells none.

    A percentage keeps its displayed number and a grade its numerator.
    """
    # Each pattern is met only by cells that hold its marks; the others are plain replacements. The number
    # of a percentage or grade is a strict one, so it is not checked again.
    marked = _point(_group(c, K.MARKED_PATTERN, 1))
    grouped, plain = decimal_point(_unsigned(c)), _point(_unsigned(c))
    bare = F.when(c.contains(".") & c.contains(","), grouped).otherwise(plain)
    return F.when(c.contains("/") | c.contains("%"), marked).otherwise(strict_number_text(bare))


def has_exponent(c: Column) -> Column:
    """Of a cell that spells a number: it is written with an exponent (``1e5``)."""
    return c.contains("e") | c.contains("E")


def _unscaled(c: Column, exponents: bool) -> Column:
    text = number_text(c)
    return text if exponents else F.when(~has_exponent(c), text)


def to_double(c: Column, scale: float | None = None, exponents: bool = True) -> Column:
    """Number held by a text cell, or NULL.

    `exponents` is False for columns that hold grades or percentages, where only
    the characters of a written amount are admitted.
    """
    value = _unscaled(c, exponents).try_cast("double")
    if scale is None:
        return value
    return F.when(is_rescaled_grade(c, scale), _rescaled(c, scale)).otherwise(value)


def to_long(c: Column, scale: float | None = None, exponents: bool = True) -> Column:
    """Same for whole-valued columns; long digit strings keep every digit."""
    if scale is not None:
        return to_double(c, scale, exponents).try_cast("bigint")
    text = _unscaled(c, exponents)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def is_whole(c: Column) -> Column:
    """Whole-valued and inside the range of a long."""
    return (c % 1 == 0) & (F.abs(c) < F.lit(9.2e18))

"""Date readings of text.

A date text is brought to ISO order by a chain of anchored replacements, checked
against one strict pattern, and read by one ``try_cast``. Text that is not a date
fails on its first characters, and no exception is raised and caught per value as
a chain of format parsers would do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_TIME = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?"
_TAIL = r"(?:[ T](" + _TIME + r"))?$"
_DAY = r"(\d{1,2})"
_MONTH_ONLY = r"(0?[1-9]|1[0-2])"
_NOT_A_MONTH = r"(1[3-9]|2\d|3[01])"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = "(?i:(" + "|".join(_MONTHS) + r")[a-z]{0,6})\.?"

# Rewriting to year-month-day; the first that matches counts. Day comes first; month first is read only
# where the second field cannot be a month. Two-digit years come last, and from 69
# they belong to the 1900s.
_REWRITES = (
    ("^" + _MONTH_ONLY + r"([/.-])" + _NOT_A_MONTH + r"\2(\d{4})" + _TAIL, "$4-$1-$3 $5"),
    ("^" + _DAY + r"([/.-])" + _DAY + r"\2(\d{4})" + _TAIL, "$4-$3-$1 $5"),
    ("^" + _MONTH_ONLY + r"([/-])" + _NOT_A_MONTH + r"\2(\d{2})$", "$4-$1-$3"),
    ("^" + _DAY + r"([/-])" + _DAY + r"\2(\d{2})$", "$4-$3-$1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
)
_SHORT_YEARS = (
    (r"^(69|[789]\d)-(\d{1,2}-\d{1,2})$", "19$1-$2"),
    (r"^(\d{2})-(\d{1,2}-\d{1,2})$", "20$1-$2"),
)
# Text that none of these rewrites changes.
_YEAR_FIRST = r"^\d{4}-"
_AFTER_YEAR = r"-\d{1,2}-\d{1,2}(?:[ T](?:" + _TIME + r"(?:Z|[+-]\d{2}:?\d{2})?)?)?$"
ISO_ANY_YEAR = r"^\d{4}" + _AFTER_YEAR
ISO_PLAUSIBLE_YEAR = r"^(?:19\d{2}|20\d{2}|2100)" + _AFTER_YEAR   # 1900 to 2100

NAMED_DAY_FIRST = r"^(\d{1,2})[ -]" + _NAME + r"[ -](\d{4})$"
NAMED_MONTH_FIRST = r"^" + _NAME + r" (\d{1,2}),? (\d{4})$"

# Cheap first look: what cannot open a date is refused by this one pattern.
_OPENING = (
    r"^(?:\d{1,4}[/.-]\d{1,2}[/.-]\d|\d{1,2}[ -][a-zA-Z]{3}|[a-zA-Z]{3,9}\.? \d)"
)
# No accepted shape is shorter or longer or without a mark, so other text is refused before any pattern runs.
SHORTEST, LONGEST = 6, 40
_MARKS = ("/", "-", ".", " ")


def _named(t: Column, pattern: str, year: int, month: int, day: int) -> Column:
    name = F.lower(F.regexp_extract(t, pattern, month))
    number = F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("string")
    return F.concat_ws("-", F.regexp_extract(t, pattern, year), number, F.regexp_extract(t, pattern, day))


def _full_year(t: Column) -> Column:
    for pattern, order in _SHORT_YEARS:
        t = F.regexp_replace(t, pattern, order)
    return t


def _two_digits_each(t: Column, year: Column) -> Column:
    """Year-month-day order of two digits, a mark, two digits, a mark and a year, by the rules of `_REWRITES`;
    compared as texts, since the strict pattern that follows refuses whatever is no digit."""
    first, second = F.substring(t, 1, 2), F.substring(t, 4, 2)
    month_first = first.between("01", "12") & second.between("13", "31")
    return F.when(month_first, F.concat(year, F.lit("-"), first, F.lit("-"), second)).otherwise(
        F.concat(year, F.lit("-"), second, F.lit("-"), first)
    )


def iso_text(t: Column) -> Column:
    """Year-month-day order of a trimmed date text; other text passes unchanged."""
    # The usual shapes are told by their lengths and marks, and no pattern but the strict one reads them:
    # no other shape has its marks there.
    at = lambda n: F.substring(t, n, 1)
    long, short, mark = F.length(t) == 10, F.length(t) == 8, at(3)
    century = F.when(F.substring(t, 7, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    out = F.when(long & (at(5) == "-") & (at(8) == "-"), t)
    out = out.when(long & mark.isin("/", "-", ".") & (mark == at(6)), _two_digits_each(t, F.substring(t, 7, 4)))
    out = out.when(
        short & mark.isin("/", "-") & (mark == at(6)), _two_digits_each(t, F.concat(century, F.substring(t, 7, 2)))
    )
    out = out.when(t.rlike(_YEAR_FIRST), t)
    for pattern, order in _REWRITES:
        rewritten = F.regexp_replace(t, pattern, order)
        if order.startswith("$4") and not order.endswith(" $5"):
            rewritten = _full_year(rewritten)
        out = out.when(t.rlike(pattern), rewritten)
    return (
        out.when(t.rlike(NAMED_DAY_FIRST), _named(t, NAMED_DAY_FIRST, 3, 2, 1))
        .when(t.rlike(NAMED_MONTH_FIRST), _named(t, NAMED_MONTH_FIRST, 3, 1, 2))
        .otherwise(_full_year(t))
    )


def to_timestamp(t: Column, bounded: bool = True) -> Column:
    """Timestamp held by a trimmed text, or NULL; with `bounded`, in a plausible year."""
    iso = F.regexp_extract(iso_text(t), ISO_PLAUSIBLE_YEAR if bounded else ISO_ANY_YEAR, 0)
    marked = reduce(Column.__or__, [t.contains(m) for m in _MARKS])
    return F.when(F.length(t).between(SHORTEST, LONGEST) & marked & t.rlike(_OPENING), iso.try_cast("timestamp_ntz"))

"""Text expressions: white space, missing markers, case and code tests.

Functions other than `strip` and `squeeze_whitespace` expect text without edge
white space; operators trim once, in a projection of their own, and reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from limpid import constants as K


# First looks, so clean text never meets the full pattern or a trim table. One plain range that
# ends below the space costs least; other characters are told by their bytes.
_CONTROL = r"[\t-\x1f]"
_LONGEST_MARKER = max(map(len, K.MISSING_MARKERS))


def beyond_ascii(c: Column) -> Column:
    """The text holds a character outside ASCII."""
    return F.octet_length(c) != F.length(c)


def has_special_space(c: Column) -> Column:
    """The text holds white space other than the plain space (or another control character)."""
    return c.rlike(_CONTROL) | (beyond_ascii(c) & c.rlike(K.WS_NOT_SPACE))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the plain space."""
    return F.when(has_special_space(c), F.trim(c, F.lit(K.WS_CHARS))).otherwise(F.trim(c))


def squeeze_whitespace(c: Column) -> Column:
    """Trim the ends and turn each run of white space into one space."""
    return F.trim(
        F.when(
            c.contains("  ") | has_special_space(c),
            F.regexp_replace(c, f"{K.WS}{{2,}}|{K.WS_NOT_SPACE}", " "),
        ).otherwise(c)
    )


def is_marker(t: Column) -> Column:
    """A written form of "no value" (``N/A``, ``--``, blanks...)."""
    # The markers are ASCII, and no other character has one of theirs as its lower case.
    return (F.octet_length(t) <= _LONGEST_MARKER) & F.lower(t).isin(*K.MISSING_MARKERS)


def is_significant(t: Column) -> Column:
    """Present, and not merely a written form of "no value"."""
    return t.isNotNull() & ~F.coalesce(is_marker(t), F.lit(False))


def is_code(t: Column) -> Column:
    """Digits led by a zero: a phone number or postal code, never a quantity."""
    zero = t.startswith("0") | t.startswith("+0") | t.startswith("-0")
    return zero & t.rlike(K.CODE_PATTERN)


def mixes_letters_and_digits(c: Column) -> Column:
    return c.rlike(r"\p{L}") & c.rlike(r"\p{Nd}")


def is_short_code(c: Column) -> Column:
    """Letters and digits mixed in fewer than ten characters."""
    return (F.length(c) < 10) & mixes_letters_and_digits(c)


def has_ascii_letter(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def changes_when_lowered(c: Column) -> Column:
    low = F.lower(c)
    return (c != low) & has_ascii_letter(c) & ~low.isin(*K.CASE_EXEMPT)


def lower_guarded(c: Column) -> Column:
    """Lowercase, except text without an ASCII letter and the "no value" words."""
    return F.when(changes_when_lowered(c), F.lower(c)).otherwise(c)

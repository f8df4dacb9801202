"""Type decisions taken from the data, and what each conversion loses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from limpid import constants as K
from limpid.functions.dates import to_timestamp
from limpid.functions.numbers import (
    grade_denominator, grade_value, has_exponent, is_rescaled_grade, is_whole, looks_numeric,
    number_text, to_double, to_long,
)
from limpid.functions.text import (
    changes_when_lowered, has_ascii_letter, has_special_space, is_code, is_short_code, is_significant,
    squeeze_whitespace, strip,
)
from limpid.operators.aggregate import collect_metrics, count_where, small_table
from limpid.operators.counts import text_metrics, unpivoted
from limpid.operators.sampling import first_n_per_group, first_present, with_order
from limpid.operators.schema import chosen, float_columns, ref, text_columns
from limpid.storage import materialised

# Bits of a sampled value's code.
NUMERIC_LOOK, SHORT_CODE, ASCII_LETTER = 1, 2, 4


@dataclass(frozen=True)
class Conversion:
    """How one text column becomes numbers or timestamps, and what that cost."""

    column: str
    kind: str                       # "bigint", "double" or "timestamp_ntz"
    scale: float | None = None      # common scale of a column of grades
    exponents: bool = True
    n_present: int = 0
    n_converted: int = 0
    n_lost: int = 0
    n_rescaled: int = 0

    def apply(self, c: Column) -> Column:
        """The converted cell, from trimmed text."""
        if self.kind == "timestamp_ntz":
            return to_timestamp(c)
        if self.kind == "bigint":
            return to_long(c, self.scale, self.exponents)
        return to_double(c, self.scale, self.exponents)


def value_code(c: Column) -> Column:
    """What the samples need to know of one present value."""
    bit = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        bit(looks_numeric(strip(c)), NUMERIC_LOOK)
        + bit(is_short_code(c), SHORT_CODE)
        + bit(has_ascii_letter(c), ASCII_LETTER)
    )


def sample_codes(
    df: DataFrame, columns: Sequence[str], order_by: str | None = None, **options
) -> dict[str, list[int]]:
    return first_present(df, columns, value_code, K.NUMERIC_SAMPLE, order_by, **options)


def sample_is_numeric(codes: Sequence[int]) -> bool:
    return bool(codes) and all(code & NUMERIC_LOOK for code in codes[: K.NUMERIC_SAMPLE])


def sample_allows_lowering(codes: Sequence[int]) -> bool:
    head = codes[: K.CASE_SAMPLE]
    return not any(code & SHORT_CODE for code in head) and any(c & ASCII_LETTER for c in head)


def code_columns(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, bool]:
    """Columns protected because one value somewhere is a code with a leading zero."""
    columns = text_columns(df) if columns is None else list(columns)
    found = text_metrics(df, columns, {"codes": lambda v: count_where(is_code(strip(v)))})
    return {c: bool(m["codes"]) for c, m in found.items()}


def full_scan_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """What `value_code` tells of a value, counted over all present values: one scan."""
    return text_metrics(
        df, columns,
        {
            "present": F.count,
            "numeric": lambda v: count_where(looks_numeric(strip(v))),
            "codes": lambda v: count_where(is_code(strip(v))),
            "short_codes": lambda v: count_where(is_short_code(v)),
            "letters": lambda v: count_where(has_ascii_letter(v)),
        },
    )


def numeric_candidates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: str | None = None,
    full_scan: bool = False,
    rate: float = K.FULL_SCAN_RATE,
) -> list[str]:
    """Text columns whose first present values all look like numbers, codes excluded.

    With `full_scan` no row order matters: a share of `rate` of all present values decides.
    """
    columns = text_columns(df) if columns is None else list(columns)
    if full_scan:
        m = full_scan_shares(df, columns)
        return [
            c for c in columns
            if m[c]["present"] and not m[c]["codes"] and m[c]["numeric"] >= rate * m[c]["present"]
        ]
    codes = sample_codes(df, columns, order_by)
    likely = [c for c in columns if sample_is_numeric(codes[c])]
    if not likely:
        return []
    protected = code_columns(df, likely)
    return [c for c in likely if not protected[c]]


def dominant_scales(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-zero denominator of each column; the largest on ties."""
    dens = df.select(*[grade_denominator(strip(ref(c))).alias(c) for c in columns])
    counted = (
        unpivoted(dens, columns)
        .select("column", F.col("value").cast("double").alias("scale"))
        .filter(F.col("scale") != 0)
        .groupBy("column", "scale")
        .agg(F.count("*").alias("n"))
    )
    order = [F.col("n").desc(), F.col("scale").desc()]
    return first_n_per_group(counted, ["column"], order, 1, spread=False)


# What a cell of a number, amount, grade or percentage can hold; the rest is not parsed as one.
_NUMBER_CHARACTERS = r"^[0-9eE+\-.,€$£/%" + K.WS + "]+$"
# Most of them: only characters below 256 and no ranges, which a regular expression looks up in one table.
_PLAIN_NUMBER_CHARACTERS = r"^[0123456789eE+\-.,$£/% ]+€?$"
# Marks of a sample: where in the row order the first value of a kind stands.
_OTHER, _SHORT, _LETTER = "other", "short", "letter"
_MARKS = (_OTHER, _SHORT, _LETTER)
# What a reading says of grades, which copies cannot be subtracted from.
_SCALED = ("scale", "on_scale")
# What a scan tells of a cell, as bits of a number.
_COUNTED = (
    "present", "text", "spaces", "case", "dates", "lost", "codes", "numbers", "whole", "exponents", "marks", "grades", *_MARKS,
)
# Rows of a value, on average, from which on equal cells are counted before they are read.
REPETITIONS = 8
# Different values, and bytes of them, of all columns together that are converted by value: they are broadcast.
MAPPED_VALUES, MAPPED_BYTES = 400_000, 32 << 20


@dataclass
class Reading:
    """How the cells of one column read, counted over the whole table in one scan.

    A sample is known by ranks. The first n present values all look like numbers if the first
    one that does not has n values before it, so the scan keeps the row key of the first value
    of each kind, and `settle_samples` counts what stands before it where that can matter.
    """

    counts: Mapping[str, int]
    first: Mapping[str, object]          # row key of the first present value, and per mark
    ahead: dict[str, int]                # per mark: present values before it, once counted

    def __getitem__(self, name: str) -> int:
        return self.counts[name]

    def within(self, mark: str, n: int) -> bool | None:
        """Whether a value of this kind is among the first `n`; None where not yet known."""
        if not self.counts[mark]:
            return False
        if self.counts["present"] <= n or self.first[mark] == self.first["present"]:
            return True
        return self.ahead[mark] < n if mark in self.ahead else None

    def looks_numeric(self, rate: float | None = None) -> bool | None:
        """By the first values, or with `rate` by the share of all of them."""
        if not self["present"]:
            return False
        if rate is not None:
            return self["present"] - self[_OTHER] >= rate * self["present"]
        other = self.within(_OTHER, K.NUMERIC_SAMPLE)
        return None if other is None else not other

    def allows_lowering(self, rate: float | None = None) -> bool | None:
        if rate is not None:
            return self[_LETTER] > 0 and self[_SHORT] <= (1 - rate) * self["present"]
        short, letter = self.within(_SHORT, K.CASE_SAMPLE), self.within(_LETTER, K.CASE_SAMPLE)
        if short or letter is False:
            return False
        return None if short is None or letter is None else True


#: Row keys of these types keep their minimum in place; others are looked up as samples are.
_FIXED_WIDTH = (T.NumericType, T.DateType, T.BooleanType)


def _row_key(df: DataFrame, order_by: str | None) -> Column | None:
    """The column that defines row order, where its minimum can be kept without a sort."""
    if order_by is None:
        return F.monotonically_increasing_id()
    return ref(order_by) if isinstance(df.schema[order_by].dataType, _FIXED_WIDTH) else None


def _cells(df: DataFrame, columns: Sequence[str], key: Column, weight: Column, place: Mapping[str, int]) -> DataFrame:
    """(at, weight, keyless, column, raw) of every cell; a column goes by its place."""
    # The key in a projection of its own: scan order is of rows, not of cells.
    named = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = df.select(key.alias("at"), weight.alias("weight"), *[ref(c).alias(n) for c, n in named.items()])
    cells = F.array(*[F.struct(F.lit(place[c]).alias("column"), F.col(n).alias("raw")) for c, n in named.items()])
    return rows.select("at", "weight", F.inline(cells)).withColumn("keyless", F.col("at").isNull())


def repetitive_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns in which a value stands in `REPETITIONS` rows or more on average, by a sketch of all rows."""
    metrics = {("", "rows"): F.count("*"), **{(c, "distinct"): F.approx_count_distinct(ref(c)) for c in columns}}
    m = collect_metrics(df, metrics)
    return [c for c in columns if m[c, "distinct"] * REPETITIONS <= m["", "rows"]]


def _equal_cells(df: DataFrame, columns: Sequence[str], key: Column, weight: Column) -> DataFrame:
    """`_cells` of `columns`, equal ones counted together; the first stands for all."""
    return _cells(df, columns, key, weight, {c: i for i, c in enumerate(columns)}).groupBy("column", "raw").agg(
        F.min("at").alias("at"), F.sum("weight").alias("weight"), F.bool_or("keyless").alias("keyless")
    )


@dataclass(frozen=True)
class Values:
    """The different texts of columns that repeat them, counted once and stored: a scan reads them instead
    of the cells, and a conversion is looked up by value."""

    columns: tuple[str, ...]
    table: DataFrame                # (column, raw, at, weight, keyless), a column by its place
    mapped: frozenset[str]          # columns with few enough values to be broadcast

    def converted(self, c: str, plan: Conversion, clean, names: Mapping[str, str]) -> DataFrame:
        """(names["raw"], names["result"]) of a column's texts, and what its conversion blanks or
        rescales by the names of `LOST` and `RESCALED`, as far as asked for."""
        text = (F.col("column") == self.columns.index(c)) & F.col("raw").isNotNull()
        said = self.table.filter(text).select("raw", clean(F.col("raw")).alias("value"))
        said = said.select("raw", "value", plan.apply(F.col("value")).alias("result"))
        value, kinds = lambda _: F.col("value"), [k for k in (LOST, RESCALED) if k in names]
        shown = [v.alias(names[k]) for k, _, v in _shown({c: plan}, kinds, value, value, lambda _: F.col("result"))]
        return said.select(F.col("raw").alias(names["raw"]), F.col("result").alias(names["result"]), *shown)

    def looked_up(
        self, df: DataFrame, plans: Mapping[str, Conversion], clean, changes: str | None = None
    ) -> tuple[DataFrame, dict[tuple[str, str], str]]:
        """The table with the texts of these columns converted. With `changes`, columns whose names begin
        so say beside it what is blanked or rescaled: the names by kind and column."""
        told: dict[tuple[str, str], str] = {}
        for i, (c, p) in enumerate(plans.items()):
            names = {"raw": f"__raw{i}", "result": f"__result{i}"}
            if changes:
                asked = [LOST] * bool(p.n_lost) + [RESCALED] * bool(p.n_rescaled and p.scale is not None)
                told |= {(k, c): f"{changes}_{k}{i}" for k in asked}
                names |= {k: told[k, c] for k in asked}
            known = F.broadcast(self.converted(c, p, clean, names))
            df = df.join(known, ref(c) == F.col(names["raw"]), "left").select(
                *[F.col(names["result"]).alias(c) if x == c else ref(x) for x in df.columns],
                *[F.col(n) for k, n in names.items() if k in (LOST, RESCALED)],
            )
        return df, told


def repeated_values(
    df: DataFrame, columns: Sequence[str], order_by: str | None = None
) -> Values | None:
    """The stored values of those of these text columns that repeat them."""
    columns = tuple(repetitive_columns(df, columns)) if columns else ()
    if not columns:
        return None
    key = _row_key(df, order_by)
    row_key = key if key is not None else F.lit(None).cast("long")
    table = materialised(_equal_cells(df, columns, row_key, F.lit(1).cast("long")), "values")
    sizes = table.groupBy("column").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("b"))
    mapped, n, size = [], 0, 0
    for r in sorted(sizes.collect(), key=lambda r: (r["n"], r["column"])):
        n, size = n + r["n"], size + r["b"]
        if n <= MAPPED_VALUES and size <= MAPPED_BYTES:
            mapped.append(columns[r["column"]])
    return Values(columns, table, frozenset(mapped))


def read_columns(
    df: DataFrame,
    columns: Sequence[str],
    order_by: str | None = None,
    squeeze: bool = False,
    bounded: bool = True,
    weight: str | None = None,
    repeated: Sequence[str] = (),
    values: Values | None = None,
) -> dict[str, Reading]:
    """Readings of text columns: one scan, and one more of the columns in `repeated`.

    With `weight`, a row counts as often as that column says.

    The aggregate is over (column, denominator of a grade, all that a cell is), then over columns,
    so the common scale of a column of grades comes from it too. With `squeeze`, decisions are
    taken on white-space-cleaned text and the changes of that treatment are counted along the way.
    Values that share a row key count as standing together.

    Of columns in `repeated` equal cells are counted first and each value is read once, with the same
    result; it pays for `repetitive_columns`. `values` holds such columns counted already.
    """
    counted = chosen(list(values.columns), columns) if values else []
    columns = [*counted, *[c for c in columns if c not in set(counted)]]
    if not columns:
        return {}
    key = _row_key(df, order_by)
    none = F.lit(None)
    bits = {name: 1 << i for i, name in enumerate(_COUNTED)}
    marked = lambda tests: reduce(
        Column.bitwiseOR, [F.when(cond, bits[n]).otherwise(0) for n, cond in tests.items()]
    )
    raw, v, text, flags, keyless = F.col("raw"), F.col("value"), F.col("text"), F.col("flags"), F.col("keyless")
    row_key = key if key is not None else none.cast("long")
    weighs = F.lit(1).cast("long") if weight is None else ref(weight).cast("long")
    again = [c for c in columns if c in set(repeated) - set(counted)]
    single = [c for c in columns if c not in {*again, *counted}]
    parts = [_cells(df, single, row_key, weighs, {c: columns.index(c) for c in single})] if single else []
    tables = [(counted, values.columns, values.table)] if counted else []
    tables += [(again, again, _equal_cells(df, again, row_key, weighs))] if again else []
    for asked, names, alike in tables:
        place = F.array(*[F.lit(columns.index(c) if c in asked else None).cast("int") for c in names])
        alike = alike.select("at", "weight", F.get(place, F.col("column")).alias("column"), "raw", "keyless")
        parts.append(alike.filter(F.col("column").isNotNull()))
    long = reduce(DataFrame.unionByName, parts)
    carried = ["at", "weight", "keyless", "column"]
    # Each step hands on two texts at most, as every step copies what it hands on.
    clean = squeeze_whitespace(raw) if squeeze else strip(raw)
    long = long.select(*carried, clean.alias("value"), marked({"spaces": raw != clean}).alias("flags"))
    odd = v.contains("€") | has_special_space(v)
    number_like = v.rlike(_PLAIN_NUMBER_CHARACTERS) | (odd & v.rlike(_NUMBER_CHARACTERS))
    long = long.withColumn("chars", F.when(number_like, v))
    number = F.col("chars")
    long = long.select(
        *carried, "value", "flags", number_text(number).alias("text"), grade_denominator(number).alias("den"),
        number.isNotNull().alias("chars"), is_code(number).alias("code"),
    )
    # Letters of a number are those of its exponent, and a text of other characters looks like a
    # number only through a semicolon or by being empty. What reads as a number looks like one, but
    # for an exponent.
    exponent = has_exponent(v)
    lettered = ~F.col("chars") | exponent
    may_look_numeric = F.col("chars") | v.contains(";") | (v == "")
    seems = F.when(text.isNotNull(), ~exponent).otherwise(may_look_numeric & looks_numeric(v))
    of_value = {
        "present": v.isNotNull(),
        "text": v.isNotNull(),
        "case": lettered & changes_when_lowered(v),
        "dates": to_timestamp(v, bounded).isNotNull(),
        "lost": is_significant(v),
        "codes": F.col("code"),
        "marks": v.contains("/") | v.contains("%"),
        _OTHER: ~seems,
        _SHORT: lettered & is_short_code(v),
        _LETTER: lettered & has_ascii_letter(v),
        "exponents": text.isNotNull() & exponent,
    }
    parsed = long.select(
        *carried, "den", text.try_cast("double").alias("number"), flags.bitwiseOR(marked(of_value)).alias("flags")
    )
    number = F.col("number")
    of_number = {"numbers": number.isNotNull(), "whole": is_whole(number), "grades": F.col("den") != 0}
    # Cells are grouped by all they are at once, some tens of combinations a column, so a cell
    # costs one count and one minimum however much is counted.
    known = parsed.select(*carried, "den", flags.bitwiseOR(marked(of_number)).alias("flags"))
    alike = known.groupBy("column", "den", "flags").agg(
        F.sum("weight").alias("rows"), F.min("at").alias("at"), F.bool_or(keyless).alias("keyless")
    )
    has = lambda name: flags.bitwiseAND(bits[name]) != 0
    joint = {
        "lost_dates": has("lost") & ~has("dates"), "lost_numbers": has("lost") & ~has("numbers"),
        "whole_exponents": has("exponents") & has("whole"),
    }
    holds = lambda name: joint[name] if name in joint else has(name)
    sums = {"rows": F.sum("rows"), **{n: F.coalesce(F.sum(F.when(holds(n), F.col("rows"))), F.lit(0)) for n in (*bits, *joint)}}
    # A null key comes before all others: a mark there has nothing before it.
    marks = {"present": holds("text"), **{m: holds(m) for m in _MARKS}}
    lows = {f"first_{m}": F.min(F.when(cond, F.col("at"))) for m, cond in marks.items()}
    nulls = {f"null_{m}": F.bool_or(cond & F.col("keyless")) for m, cond in marks.items()}
    every = {**sums, **lows, **nulls}
    per_scale = alike.groupBy("column", "den").agg(*[e.alias(n) for n, e in every.items()])
    scale, n_scale = F.when(F.col("den") != 0, F.col("den")), F.col("rows")
    rows = per_scale.groupBy("column").agg(
        *[F.sum(n).alias(n) for n in sums], *[F.min(n).alias(n) for n in lows], *[F.bool_or(n).alias(n) for n in nulls],
        F.max(F.when(scale.isNotNull(), F.struct(n_scale.alias("n"), scale.alias("scale")))).alias("scale"),
    ).collect()
    found = {}
    for r in rows:
        counts = {n: r[n] for n in sums}
        counts["scale"], counts["on_scale"] = (r["scale"]["scale"], r["scale"]["n"]) if r["scale"] else (None, 0)
        first = {m: None if r[f"null_{m}"] else r[f"first_{m}"] for m in marks}
        found[columns[r["column"]]] = Reading(counts, first, {})
    nothing = {**dict.fromkeys(sums, 0), "scale": None, "on_scale": 0}
    out = {c: found.get(c, Reading(nothing, dict.fromkeys(marks), {})) for c in columns}
    if key is None:
        _settle_by_sample(df, columns, out, order_by, squeeze)
    return out


def presence(df: DataFrame, columns: Sequence[str]) -> dict[str, Reading]:
    """What `read_columns` tells of columns that are no text, from a scan of those alone."""
    floats = set(float_columns(df))
    metrics = {("", "rows"): F.count("*")}
    for c in columns:
        metrics[c, "present"] = F.count(ref(c))
        if c in floats:
            metrics[c, "held_whole"] = count_where(is_whole(ref(c)))
    m = collect_metrics(df, metrics)
    return {
        c: Reading({"rows": m["", "rows"], "present": m[c, "present"], "held_whole": m.get((c, "held_whole"), 0)}, {}, {})
        for c in columns
    }


def fixed_keys(df: DataFrame, order_by: str | None) -> bool:
    """Row order is by a column whose smallest values `read_columns` keeps."""
    return _row_key(df, order_by) is not None


def less_copies(readings: Mapping[str, Reading], copies: DataFrame, weight: str, order_by: str | None) -> dict[str, Reading]:
    """Readings of squeezed text columns once copies of rows that stay are gone, `weight` of each row
    of `copies`. No first value changes, as the first of equal rows stays; ranks are open again."""
    gone = read_columns(copies, list(readings), order_by, squeeze=True, weight=weight)
    return {
        c: Reading({**{n: k - gone[c][n] for n, k in r.counts.items() if n not in _SCALED}, "scale": None, "on_scale": 0, "spaces": 0}, r.first, {})
        for c, r in readings.items()
    }


def _settle_by_sample(df, columns, readings, order_by, squeeze) -> None:
    """Row keys of variable width: ranks come from the sample itself."""
    if squeeze:
        texts = set(columns)
        df = df.select(*[squeeze_whitespace(ref(c)).alias(c) if c in texts else ref(c) for c in df.columns])
    bits = {_OTHER: (NUMERIC_LOOK, 0), _SHORT: (SHORT_CODE, SHORT_CODE), _LETTER: (ASCII_LETTER, ASCII_LETTER)}
    for c, codes in sample_codes(df, columns, order_by).items():
        readings[c] = r = Reading(readings[c].counts, {**readings[c].first, "present": True}, {})
        for mark, (bit, value) in bits.items():
            r.ahead[mark] = next((i for i, code in enumerate(codes) if code & bit == value), K.NUMERIC_SAMPLE)


def _numbers(r: Reading) -> tuple[int, int, bool]:
    """(cells that read as numbers, those refused for their exponent, exponents admitted)."""
    exponents = not r["marks"]
    refused = 0 if exponents else r["exponents"]
    return r["numbers"] - refused, refused, exponents


def _may_be_numeric(r: Reading, n: int | None = None) -> bool:
    n = _numbers(r)[0] if n is None else n
    return bool(r["present"]) and not r["codes"] and n / r["present"] > K.NUMERIC_ACCEPTANCE


def settle_samples(
    df: DataFrame, readings: Mapping[str, Reading], order_by: str | None = None, lowering: Sequence[str] = ()
) -> None:
    """Count what the first scan left open: ranks that can change a decision.

    That is of columns that would convert, and of columns in `lowering` whose case would change.
    Only rows up to the last key in question are read, a filter that reaches the scan, and
    only the columns in question.
    """
    asked: dict = {}
    for c, r in readings.items():
        marks = []
        if _may_be_numeric(r, r["numbers"]) and r.looks_numeric() is None:
            marks.append(_OTHER)
        if c in lowering and r["case"] and r.allows_lowering() is None:
            marks += [m for m in (_SHORT, _LETTER) if r.within(m, K.CASE_SAMPLE) is None]
        asked |= {(c, m): r.first[m] for m in marks}
    if not asked:
        return
    named = {c: f"c{i}" for i, c in enumerate({c: None for c, _ in asked})}
    keyed = df.select(_row_key(df, order_by).alias("at"), *[ref(c).alias(n) for c, n in named.items()])
    key = F.col("at")
    before = lambda k: F.lit(False) if k is None else key.isNull() | (key < F.lit(k))
    last = max((k for k in asked.values() if k is not None), default=None)
    counts = {(c, m): count_where(F.col(named[c]).isNotNull() & before(k)) for (c, m), k in asked.items()}
    for (c, m), n in collect_metrics(keyed.filter(before(last)), counts).items():
        readings[c].ahead[m] = n


def _whole_on_scale(df: DataFrame, plans: Mapping[str, Conversion], values: Values | None = None) -> dict[str, bool]:
    """Whether all grades of a column are whole on its common scale."""
    metrics = {}
    for c, p in plans.items():
        if values and c in values.columns:
            continue
        value = to_double(ref(c), p.scale, p.exponents)
        metrics[c, "n"], metrics[c, "whole"] = F.count(value), count_where(is_whole(value))
    found = collect_metrics(trimmed(df, plans), metrics) if metrics else {}
    names = {"raw": "raw", "result": "value"}
    for c, p in plans.items():
        if values and c in values.columns:
            counts = {(c, "n"): F.count("value"), (c, "whole"): count_where(is_whole(F.col("value")))}
            found |= collect_metrics(values.converted(c, replace(p, kind="double"), strip, names), counts)
    return {c: found[c, "n"] == found[c, "whole"] for c in plans}


def fit_conversions(
    columns: Sequence[str], readings: Mapping[str, Reading], rate: float | None = None
) -> dict[str, Conversion]:
    """Decide the type of each text column from its reading, samples being settled.

    The first present values decide whether a column may become a number, or with `rate` that
    share of all of them. A column of grades is double until it is known whether all are whole
    on their common scale.
    """
    plans: dict[str, Conversion] = {}
    for c in columns:
        r = readings[c]
        present = r["present"]
        if not present:
            continue
        if _may_be_numeric(r) and r.looks_numeric(rate):
            n, refused, exponents = _numbers(r)
            lost, whole = r["lost_numbers"] + refused, r["whole"] - (0 if exponents else r["whole_exponents"])
            if r["grades"]:
                plans[c] = Conversion(c, "double", r["scale"], exponents, present, n, lost, r["grades"] - r["on_scale"])
            else:
                plans[c] = Conversion(c, "bigint" if whole == n else "double", None, exponents, present, n, lost)
        elif r["dates"] / present > K.DATE_ACCEPTANCE:
            plans[c] = Conversion(c, "timestamp_ntz", None, True, present, r["dates"], r["lost_dates"])
    return plans


def on_a_scale(plans: Mapping[str, Conversion]) -> dict[str, Conversion]:
    return {c: p for c, p in plans.items() if p.scale is not None}


def trimmed(df: DataFrame, columns) -> DataFrame:
    """The table with some text columns trimmed, in a projection of its own."""
    names = set(columns)
    return df.select(*[strip(ref(c)).alias(c) if c in names else ref(c) for c in df.columns])


def convert(df: DataFrame, plans: Mapping[str, Conversion], values: Values | None = None) -> DataFrame:
    """The converted table; with `values` of this very table, columns with few of them by value."""
    known = {c: p for c, p in plans.items() if values and c in values.mapped}
    plans = {c: p for c, p in plans.items() if c not in known}
    if known:
        df = values.looked_up(df, known, strip)[0]
    df = trimmed(df, plans)
    return df.select(*[plans[c].apply(ref(c)).alias(c) if c in plans else ref(c) for c in df.columns])


def clean_types(
    df: DataFrame, order_by: str | None = None, columns: Sequence[str] | None = None, rate: float | None = None,
    values: Values | None = None,
) -> tuple[DataFrame, dict[str, Conversion]]:
    """Convert text columns to numbers or timestamps where the data calls for it.

    With `rate` no row order matters: that share of all present values decides. `values` are those
    of `repeated_values` of this table, which are then read and converted once each.
    """
    columns = text_columns(df) if columns is None else list(columns)
    readings = read_columns(df, columns, order_by, values=values)
    if rate is None:
        settle_samples(df, readings, order_by)
    plans = fit_conversions(columns, readings, rate)
    whole = _whole_on_scale(df, on_a_scale(plans), values)
    plans.update({c: replace(plans[c], kind="bigint") for c, yes in whole.items() if yes})
    return convert(df, plans, values), plans


def whole_float_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Floating columns whose present values are all whole."""
    columns = float_columns(df) if columns is None else list(columns)
    metrics = {}
    for c in columns:
        metrics[(c, "present")] = F.count(ref(c))
        metrics[(c, "whole")] = count_where(is_whole(ref(c)))
    m = collect_metrics(df, metrics)
    return [c for c in columns if m[(c, "present")] and m[(c, "present")] == m[(c, "whole")]]


def recover_integers(df: DataFrame) -> tuple[DataFrame, list[str]]:
    whole = set(whole_float_columns(df))
    out = df.select(*[ref(c).cast("bigint").alias(c) if c in whole else ref(c) for c in df.columns])
    return out, [c for c in df.columns if c in whole]


# --- accounts of what a conversion did --------------------------------------------------


LOST, RESCALED = "values_unparsed", "grades_rescaled"


def _short_number(v: Column) -> Column:
    text = F.format_string("%.6g", v)
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _shown(plans: Mapping[str, Conversion], kinds: Sequence[str], raw, value, result=None) -> list[tuple[str, str, Column]]:
    """(kind, column, text) of what a conversion blanks or rescales; null for other cells.
    `raw` and `value` give a column's text as it was, and trimmed; `result` what it became, if known."""
    result = result or (lambda c: plans[c].apply(value(c)))
    shown = []
    for c, p in plans.items():
        v = value(c)
        if LOST in kinds:
            shown.append((LOST, c, F.when(result(c).isNull() & is_significant(v), raw(c))))
        if RESCALED in kinds and p.scale is not None and p.kind != "timestamp_ntz":
            line = F.concat(v, F.lit(" → "), _short_number(grade_value(v, p.scale)))
            shown.append((RESCALED, c, F.when(is_rescaled_grade(v, p.scale), F.translate(line, ".", ","))))
    return shown


def _structs(at: Column, shown: list[tuple[str, str, Column]]) -> Column:
    return F.array(
        *[F.struct(at.alias("at"), F.lit(k).alias("kind"), F.lit(c).alias("column"), v.alias("value")) for k, c, v in shown]
    )


def with_changes(
    df: DataFrame, plans: Mapping[str, Conversion], at: str, was: Mapping[str, str], name: str,
    told: Mapping[tuple[str, str], str] | None = None,
) -> DataFrame:
    """Beside a table of conversions' results, a column `name` of what they blank or rescale in the
    row: an array of (at, kind, column, value), null for most rows. `was` names the columns that
    hold the squeezed texts; they go out, and so does `at`, which holds the row's key, and the
    columns in `told`, by kind and column, that say so already."""
    told = told or {}
    plans = {c: p for c, p in plans.items() if c in was and (p.n_lost or p.n_rescaled)}
    raw = lambda c: ref(was[c])
    shown = _shown(plans, (LOST, RESCALED), raw, raw, ref) + [(k, c, ref(n)) for (k, c), n in told.items()]
    kept = [c for c in df.columns if c not in {at, *was.values(), *told.values()}]
    if not shown:
        return df.select(*[ref(c) for c in kept])
    places = [f"{name}{i}" for i in range(len(shown))]
    # In a projection of their own, so that no text is read twice or out of generated code.
    said = df.select(*[ref(c) for c in kept], ref(at), *[v.alias(n) for n, (_, _, v) in zip(places, shown)])
    cells = _structs(ref(at), [(k, c, ref(n)) for n, (k, c, _) in zip(places, shown)])
    some = F.coalesce(*[ref(n) for n in places]).isNotNull()
    changes = F.when(some, F.filter(cells, lambda x: x["value"].isNotNull()))
    return said.select(*[ref(c) for c in kept], changes.alias(name))


def _changed_cells(
    df: DataFrame, plans: Mapping[str, Conversion], order_by: str | None, kinds: Sequence[str]
) -> DataFrame | None:
    """(at, kind, column, value) of the cells a conversion blanks or rescales."""
    ordered, order = with_order(df, order_by)
    cells = ordered.select(
        ref(order[0]).alias("at"),
        *[ref(c).alias(f"__r{i}") for i, c in enumerate(plans)],
        *[strip(ref(c)).alias(f"__v{i}") for i, c in enumerate(plans)],
    )
    place = {c: i for i, c in enumerate(plans)}
    shown = _shown(plans, kinds, lambda c: F.col(f"__r{place[c]}"), lambda c: F.col(f"__v{place[c]}"))
    if not shown:
        return None
    return cells.select(F.inline(_structs(F.col("at"), shown))).filter(F.col("value").isNotNull())


def changed_values(
    df: DataFrame,
    plans: Mapping[str, Conversion],
    order_by: str | None = None,
    n: int = K.EXAMPLES_KEPT,
    kinds: Sequence[str] = (LOST, RESCALED),
) -> DataFrame:
    """(kind, column, n_values, examples) of what conversions blanked or rescaled.

    Examples are the first `n` distinct values by first appearance. Equal values
    combine map-side before anything is shuffled.
    """
    cells = _changed_cells(df, plans, order_by, kinds) if plans else None
    if cells is None:
        return small_table(
            df.sparkSession, [], "kind string, column string, n_values long, examples array<string>"
        )
    grouped = cells.groupBy("kind", "column", "value").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    keys = ["kind", "column"]
    totals = grouped.groupBy(*keys).agg(F.sum("n").alias("n_values"))
    return totals.join(_first_values(grouped, keys, n), keys)


def _first_values(grouped: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return (
        first_n_per_group(grouped, keys, [F.col("at"), F.col("value")], n, spread=False)
        .groupBy(*keys)
        .agg(F.transform(ordered, lambda x: x["value"]).alias("examples"))
    )


def change_examples(cells: DataFrame, n: int = K.EXAMPLES_KEPT) -> dict[tuple[str, str], list[str]]:
    """The first `n` distinct values per kind and column, from what `change_column` left."""
    grouped = cells.groupBy("kind", "column", "value").agg(F.min("at").alias("at"))
    rows = _first_values(grouped, ["kind", "column"], n).collect()
    return {(r["kind"], r["column"]): r["examples"] for r in rows}


def unparsed_values(
    df: DataFrame, plans: Mapping[str, Conversion], order_by: str | None = None,
    n: int = K.EXAMPLES_KEPT,
) -> DataFrame:
    """Present values that a conversion blanks: count and first examples per column."""
    return changed_values(df, plans, order_by, n, (LOST,)).drop("kind")


def rescaled_grades(
    df: DataFrame, plans: Mapping[str, Conversion], order_by: str | None = None,
    n: int = K.EXAMPLES_KEPT,
) -> DataFrame:
    """Grades brought to the common scale of their column: count and first examples."""
    scales = [F.lit(x) for c, p in plans.items() if p.scale is not None for x in (c, float(p.scale))]
    found = changed_values(df, plans, order_by, n, (RESCALED,)).drop("kind")
    scale = F.create_map(*scales)[F.col("column")] if scales else F.lit(None)
    return found.withColumn("scale", scale.cast("double"))


def mistyped_columns(df: DataFrame, order_by: str | None = None) -> dict[str, str]:
    """Text columns that still read as numbers or dates.

    Any year counts here, as the question is whether the text spells a date.
    """
    texts = text_columns(df)
    readings = read_columns(df, texts, order_by, bounded=False, values=repeated_values(df, texts, order_by))
    settle_samples(df, readings, order_by)
    found = {}
    for c, r in readings.items():
        if not r["present"]:
            continue
        if _may_be_numeric(r, r["numbers"]) and r.looks_numeric():
            found[c] = "number"
        elif r["dates"] / r["present"] > K.DATE_ACCEPTANCE:
            found[c] = "date"
    return found

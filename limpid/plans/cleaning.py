"""Fitted cleaning: decide from the data once, then apply as plain projections.

`fit_cleaning` runs a fixed, small number of jobs per pass and returns a
`CleaningPlan`: a list of literals and names that can be stored as JSON and
applied again, to the same table or to new rows, without looking at data.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, functions as F

from limpid import constants as K
from limpid.functions.numbers import is_whole
from limpid.functions.text import lower_guarded, squeeze_whitespace
from limpid.operators.aggregate import count_where
from limpid.operators.duplicates import FINGERPRINT, REMOVED, fingerprint, without_duplicates
from limpid.operators.fill import Fill, fill, fit_fills
from limpid.operators.outliers import clip_limits, clipped, count_outside, iqr_bounds
from limpid.operators.schema import (
    chosen, float_columns, nan_to_null, numeric_columns, ref, text_columns,
)
from limpid.operators.typing import (
    Conversion, Reading, Values, fit_conversions, fixed_keys, less_copies, on_a_scale, presence, read_columns,
    repeated_values, settle_samples, with_changes,
)
from limpid.options import CleaningOptions, decide
from limpid.session import tune
from limpid.storage import materialised

# Row order of a run whose caller names no order column; never part of the data.
ROW = "__row_order"
# Beside a typed table: what the conversions of each row blanked or rescaled.
CHANGES = "__changes"
_HIDDEN = (ROW, FINGERPRINT, CHANGES)
_ALL = "__all"


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in _HIDDEN]


@dataclass
class Pass:
    """What one pass changes, and how much it changed."""

    whitespace: dict[str, int] = field(default_factory=dict)
    integers: list[str] = field(default_factory=list)
    conversions: dict[str, Conversion] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    lowered: dict[str, int] = field(default_factory=dict)
    duplicates: int = 0
    n_rows: int = 0

    @property
    def changes(self) -> bool:
        return bool(
            self.whitespace or self.integers or self.conversions or self.dropped
            or self.lowered or self.duplicates
        )

    def project(
        self, df: DataFrame, changes: str | None = None, at: str | None = None, fitted: bool = False,
        values: Values | None = None,
    ) -> DataFrame:
        """Every column treatment of the pass, as one projection.

        With `changes`, a column of that name says what the conversions blank or rescale in
        the row, whose key is `at`; it is left out where they do neither. `fitted` says that this is
        the table the pass was fitted on: white space is looked for only where it was found. `values`
        are those of that table, by which columns with few of them are converted.
        """
        texts = set(text_columns(df))
        kept = [c for c in df.columns if c not in self.dropped]
        df = df.select(*[ref(c) for c in kept])
        said, told = bool(changes) and at in kept, {}
        known = {c: p for c, p in self.conversions.items() if values and c in values.mapped and c in kept and c != at}
        if known:
            df, told = values.looked_up(df, known, squeeze_whitespace, changes if said else None)
        texts -= set(known)
        beside = list(told.values())
        spacious = set(self.whitespace) if fitted else texts
        # White space first, in a projection of its own: later steps refer to it often.
        spaced = df.select(
            *[squeeze_whitespace(ref(c)).alias(c) if c in texts & spacious else ref(c) for c in [*kept, *beside]]
        )
        out = []
        for c in kept:
            v = ref(c)
            if c in texts and c in self.conversions:
                v = self.conversions[c].apply(v)
            elif c in texts and c in self.lowered:
                v = lower_guarded(v)
            elif c in self.integers and c not in texts and c not in known:
                v = v.cast("bigint")
            out.append(v.alias(c))
        if not said:
            return spaced.select(*out)
        was = {c: f"{changes}_was_{c}" for c in kept if c in texts and c in self.conversions}
        key = f"{changes}_at"
        row = spaced.select(
            *out, ref(at).alias(key), *[ref(c).alias(n) for c, n in was.items()], *[ref(n) for n in beside]
        )
        return with_changes(row, self.conversions, key, was, changes, told)


@dataclass
class CleaningPlan:
    """The fitted decisions of a run and the counts that account for them."""

    columns_before: list[tuple[str, str]]
    columns_after: list[tuple[str, str]]
    rows_before: int
    rows_after: int
    passes: list[Pass]
    fills: dict[str, Fill]
    clips: dict[str, dict]
    options: CleaningOptions

    def typed(self, df: DataFrame) -> DataFrame:
        """Column treatments only: no row is removed, no value filled or clipped."""
        out = nan_to_null(df)
        for p in self.passes:
            out = p.project(out)
        return out

    def apply(self, df: DataFrame, deduplicate: bool = True) -> DataFrame:
        """The cleaned table: only projections, and one exact deduplication."""
        out = self.typed(df)
        if deduplicate and any(p.duplicates for p in self.passes):
            out = out.dropDuplicates()
        return self.finish(out)

    def finish(self, typed: DataFrame) -> DataFrame:
        filled = fill(typed, self.fills)
        types = {f.name: f.dataType for f in filled.schema}
        return filled.select(
            *[
                clipped(ref(c), tuple(self.clips[c]["limits"]), types[c]).alias(c)
                if c in self.clips
                else ref(c)
                for c in filled.columns
            ]
        )

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "CleaningPlan":
        d = json.loads(text)
        passes = [
            Pass(**{**p, "conversions": {c: Conversion(**v) for c, v in p["conversions"].items()}})
            for p in d["passes"]
        ]
        return cls(
            [tuple(x) for x in d["columns_before"]],
            [tuple(x) for x in d["columns_after"]],
            d["rows_before"],
            d["rows_after"],
            passes,
            {c: Fill(**f) for c, f in d["fills"].items()},
            d["clips"],
            CleaningOptions(**d["options"]),
        )


@dataclass
class CleaningResult:
    plan: CleaningPlan
    table: DataFrame
    source: DataFrame
    # Per pass: (at, kind, column, value) of the cells it blanked or rescaled, as written with
    # the typed table; None where it did neither.
    changed: list[DataFrame | None] = field(default_factory=list)


def _schema(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def fit_pass(
    df: DataFrame, options: CleaningOptions, known: Mapping[str, Reading] | None = None
) -> tuple[Pass, dict[str, Reading], Values | None]:
    """Decide one pass in a scan of the text, narrow ones of the other columns and of text that repeats
    its values, and a look at the first rows where a sample is still open. Columns of grades are double
    until the pass has been written.

    After the first pass the table is stored with its types, and `known` readings of text columns are
    not taken again: the text left is scanned by itself, and the other columns are counted in place."""
    texts = text_columns(df)
    floats = float_columns(df)
    others = [c for c in _data_columns(df) if c not in set(texts)]
    order_by = options.order_by or ROW
    # A constant column counts the rows of a table of any width.
    marked = df.withColumn(_ALL, F.lit(True))
    known = known or {}
    fresh = [c for c in texts if c not in known]
    values = repeated_values(df, fresh, order_by)
    read = {**known, **read_columns(df, fresh, order_by, squeeze=True, values=values), **presence(marked, [*others, _ALL])}
    rows = read[_ALL]["rows"]
    out = Pass(n_rows=rows)
    if not rows:
        return out, {}, None
    rate = options.full_scan_rate if options.full_scan else None
    cased = chosen(texts, options.case_columns or None)
    out.whitespace = {c: read[c]["spaces"] for c in texts if read[c]["spaces"]}
    out.integers = [c for c in floats if read[c]["present"] and read[c]["held_whole"] == read[c]["present"]]
    if rate is None:
        settle_samples(df, {c: read[c] for c in texts}, order_by, cased)
    out.conversions = fit_conversions(texts, read, rate)
    for c in _data_columns(df):
        present = out.conversions[c].n_converted if c in out.conversions else read[c]["present"]
        if (rows - present) / rows >= K.EMPTY_COLUMN_RATIO:
            out.dropped.append(c)
    gone = set(out.dropped)
    out.lowered = {
        c: read[c]["case"]
        for c in cased
        if c not in out.conversions and c not in gone and read[c]["case"] and read[c].allows_lowering(rate)
    }
    return out, {c: read[c] for c in texts}, values


def _still_known(p: Pass, read: Mapping[str, Reading], order_by: str | None) -> dict[str, Reading]:
    """Readings that hold for the text of the pass's result as well, rows aside: of columns that it
    only freed of white space. None hold where the pass may have changed the order of rows."""
    if order_by in {*p.conversions, *p.integers, *p.lowered, *p.dropped, *p.whitespace}:
        return {}
    changed = {*p.conversions, *p.dropped, *p.lowered}
    return {c: r for c, r in read.items() if c not in changed and not r["grades"]}


def _written(typed: DataFrame, conversions: dict[str, Conversion]) -> tuple[DataFrame, dict[str, Conversion]]:
    """The typed table, written. Whether all grades of a column are whole on their scale is
    observed by the same job; such columns are integers from then on."""
    graded = list(on_a_scale(conversions))
    if graded:
        seen = Observation()
        whole = [(count_where(is_whole(ref(c))) == F.count(ref(c))).alias(f"g{i}") for i, c in enumerate(graded)]
        typed = typed.observe(seen, *whole)
    stored = materialised(typed, "typed")
    whole = {c for i, c in enumerate(graded) if seen.get[f"g{i}"]} if graded else set()
    stored = stored.select(*[ref(c).cast("bigint").alias(c) if c in whole else ref(c) for c in stored.columns])
    return stored, {c: replace(v, kind="bigint") if c in whole else v for c, v in conversions.items()}


def fit_cleaning(df: DataFrame, options: CleaningOptions | None = None) -> CleaningResult:
    """Fit a cleaning run and return the plan with the cleaned table.

    Passes repeat until nothing changes. Only removed duplicates can reopen a
    decision (they move samples and rates), so a pass that removes none is the
    last.
    """
    options = options or CleaningOptions()
    tune(df.sparkSession)
    current = nan_to_null(df)
    if options.order_by is None:
        current = current.withColumn(ROW, F.monotonically_increasing_id())
    passes: list[Pass] = []
    changed_cells: list[DataFrame | None] = []
    known = None
    for _ in range(options.max_passes):
        p, read, values = fit_pass(current, options, known)
        passes.append(p)
        changed_cells.append(None)
        if len(passes) > 1 and not p.changes:
            break
        changed = p.changes
        keyed = fixed_keys(current, options.order_by or ROW)
        current = p.project(current, CHANGES, options.order_by or ROW, fitted=True, values=values)
        current = current.withColumn(FINGERPRINT, fingerprint(_data_columns(current)))
        if changed:
            # Written once with its fingerprints: every later job reads typed columns
            # instead of parsing the source text again.
            # What the conversions lost stands beside them, so no account parses it again.
            current, p.conversions = _written(current, p.conversions)
            if CHANGES in current.columns:
                changed_cells[-1] = current.select(F.inline(CHANGES))
                current = current.drop(CHANGES)
        row = ROW if options.order_by is None else None
        current, p.duplicates, copies = without_duplicates(current, row)
        if not p.duplicates:
            break
        kept = _still_known(p, read, options.order_by) if keyed and copies is not None else {}
        known = less_copies(kept, copies, REMOVED, options.order_by or ROW) if kept else {}
    current = current.select(*[ref(c) for c in _data_columns(current)])
    rows_before = passes[0].n_rows
    rows_after = rows_before - sum(p.duplicates for p in passes)
    filling = bool(decide(options.fill_missing) and rows_after)
    clipping = bool(decide(options.correct_outliers) and rows_after)
    if rows_after < rows_before and (filling or clipping):
        # Medians and fences take many scans of a few columns, none of which should look for copies again.
        current = materialised(current, "kept")

    fills = fit_fills(current, options.missing_columns) if filling else {}
    filled = fill(current, fills)
    clips: dict[str, dict] = {}
    if clipping:
        cols = chosen(numeric_columns(filled), options.outlier_columns)
        thresholds = options.outlier_thresholds or {}
        bounds = iqr_bounds(filled, cols, thresholds)
        types = {f.name: f.dataType for f in filled.schema}
        for c, n in (count_outside(filled, bounds) if bounds else {}).items():
            if n:
                clips[c] = {
                    "limits": clip_limits(bounds[c], types[c]),
                    "count": n,
                    "threshold": float(thresholds.get(c, K.IQR_FACTOR)),
                }
    plan = CleaningPlan(
        _schema(df), [], rows_before, rows_after, passes, fills, clips, options
    )
    table = plan.finish(current)
    plan.columns_after = _schema(table)
    return CleaningResult(plan, table, df, changed_cells)


def clean(
    df: DataFrame, options: CleaningOptions | None = None, **decisions
) -> DataFrame:
    """Shortcut: the cleaned table. Keyword decisions build the options."""
    return fit_cleaning(df, options or CleaningOptions(**decisions)).table

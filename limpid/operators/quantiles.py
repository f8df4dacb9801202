"""Exact quantiles at any size.

Spark's `percentile` keeps every distinct value of a column in one task. That is
fine for a small table and impossible for a large one, so past `DIRECT_CELLS` the
quantile is found by narrowing: a sketch gives two values that enclose it, one
aggregate counts what lies below and between them, and the loop repeats inside
the enclosing pair until the few values left can be ordered exactly. No task
holds more than a sketch and no step shuffles more than a sketch per task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from limpid.operators.aggregate import collect_metrics, count_where
from limpid.operators.schema import ref

# Present cells up to which one `percentile` aggregate is used.
DIRECT_CELLS = 2_000_000
# Distinct values of one enclosing pair that may be fetched to be ordered.
FETCH_VALUES = 5_000
# Sketch accuracy; the relative rank error is its inverse.
ACCURACY = 10_000
_MAX_ROUNDS = 40

QUARTILES = (0.25, 0.5, 0.75)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    present: Mapping[str, int] | None = None,
    direct_cells: int = DIRECT_CELLS,
    fetch_values: int = FETCH_VALUES,
    accuracy: int = ACCURACY,
) -> dict[str, tuple[float | None, ...]]:
    """Linearly interpolated quantiles of numeric columns, missing values left out.

    `present` gives the number of present values per column when the caller
    already knows it.
    """
    columns = list(columns)
    if not columns:
        return {}
    if present is None:
        present = collect_metrics(df, {c: F.count(ref(c)) for c in columns})
    if sum(present[c] for c in columns) <= direct_cells:
        found = collect_metrics(
            df, {c: F.percentile(ref(c).cast("double"), F.array(*map(F.lit, probs))) for c in columns}
        )
        return {c: tuple(found[c]) if found[c] else (None,) * len(probs) for c in columns}

    wanted: dict[tuple[str, int], None] = {}
    for c in columns:
        for p in probs:
            if present[c]:
                pos = (present[c] - 1) * p
                wanted[(c, math.floor(pos))] = wanted[(c, math.ceil(pos))] = None
    values = _ranked_values(df, list(wanted), present, fetch_values, accuracy)
    out = {}
    for c in columns:
        if not present[c]:
            out[c] = (None,) * len(probs)
            continue
        row = []
        for p in probs:
            pos = (present[c] - 1) * p
            lo, hi = values[(c, math.floor(pos))], values[(c, math.ceil(pos))]
            row.append(lo + (hi - lo) * (pos - math.floor(pos)))
        out[c] = tuple(row)
    return out


def _ranked_values(df, wanted, present, fetch_values, accuracy) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank of a column's ascending order."""
    names = list({c: None for c, _ in wanted})
    cells = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    col = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    # Per target: everything below `low` is counted in `below`; `inside` values lie in [low, high].
    state = {t: {"low": None, "high": None, "below": 0, "inside": present[t[0]]} for t in wanted}
    done: dict[tuple[str, int], float] = {}
    fetch: list[tuple[str, int]] = []
    open_ = list(wanted)

    for _ in range(_MAX_ROUNDS):
        if not open_:
            break
        # Targets that search the same interval of a column share one sketch.
        groups: dict[tuple, list] = {}
        for t in open_:
            groups.setdefault((t[0], state[t]["low"], state[t]["high"]), []).append(t)
        probs = {g: sorted({p for t in ts for p in _bracket(t, state[t], accuracy)}) for g, ts in groups.items()}
        sketches = collect_metrics(
            cells,
            {g: F.percentile_approx(_within(col[g[0]], g[1], g[2]), F.array(*map(F.lit, ps)), accuracy)
             for g, ps in probs.items()},
        )
        pairs, counts = {}, {}
        for g, ts in groups.items():
            value = dict(zip(probs[g], sketches[g]))
            inside = _within(col[g[0]], g[1], g[2])
            for t in ts:
                pairs[t] = tuple(value[p] for p in _bracket(t, state[t], accuracy))
                for cut in pairs[t]:
                    counts[(g, cut, "lt")] = count_where(inside < cut)
                    counts[(g, cut, "le")] = count_where(inside <= cut)
        found = collect_metrics(cells, counts)
        n = {}
        for g, ts in groups.items():
            for t in ts:
                for name, cut in zip(("lo", "hi"), pairs[t]):
                    n[(t, f"lt_{name}")] = found[(g, cut, "lt")]
                    n[(t, f"le_{name}")] = found[(g, cut, "le")]
        still = []
        for t in open_:
            lo, hi = pairs[t]
            s = state[t]
            rank = t[1] - s["below"]
            if n[(t, "lt_lo")] <= rank < n[(t, "le_lo")]:
                done[t] = lo
            elif n[(t, "lt_hi")] <= rank < n[(t, "le_hi")]:
                done[t] = hi
            else:
                # Keep the side of the pair that still encloses the rank.
                if rank < n[(t, "lt_lo")]:
                    low, high, below, inside = s["low"], lo, 0, n[(t, "lt_lo")]
                elif rank >= n[(t, "le_hi")]:
                    low, high, below, inside = hi, s["high"], n[(t, "le_hi")], s["inside"] - n[(t, "le_hi")]
                else:
                    low, high, below, inside = lo, hi, n[(t, "le_lo")], n[(t, "lt_hi")] - n[(t, "le_lo")]
                state[t] = {"low": low, "high": high, "below": s["below"] + below, "inside": inside}
                (fetch if inside <= fetch_values else still).append(t)
        open_ = still
    if open_:
        raise RuntimeError("quantile search did not settle")
    if fetch:
        done.update(_fetch_ranks(cells, col, fetch, state))
    return done


def _within(c, low, high):
    """The column cut to the open interval between the pair; NULL outside it."""
    if low is None and high is None:
        return c
    above = F.lit(True) if low is None else c > low
    below = F.lit(True) if high is None else c < high
    return F.when(above & below, c)


def _bracket(t, s, accuracy):
    """Two fractions that enclose a rank, allowing for the error of the sketch."""
    p = (t[1] - s["below"] + 0.5) / max(s["inside"], 1)
    eps = 2.0 / accuracy
    return min(1.0, max(0.0, p - eps)), min(1.0, max(0.0, p + eps))


def _fetch_ranks(cells, col, targets, state):
    """Order the few values left between each pair."""
    # Targets left in the same interval share its values.
    intervals = list({(t[0], state[t]["low"], state[t]["high"]): None for t in targets})
    found = [_within(col[c], low, high) for c, low, high in intervals]
    left = F.array(*[F.struct(F.lit(i).alias("t"), v.alias("v")) for i, v in enumerate(found)])
    rows = (
        cells.filter(F.coalesce(*found).isNotNull())
        .select(F.inline(F.filter(left, lambda x: x["v"].isNotNull())))
        .groupBy("t", "v")
        .count()
        .collect()
    )
    by_target: dict[int, list] = {}
    for r in rows:
        by_target.setdefault(r["t"], []).append((r["v"], r["count"]))
    out = {}
    for t in targets:
        at = intervals.index((t[0], state[t]["low"], state[t]["high"]))
        ahead = t[1] - state[t]["below"]
        for v, k in sorted(by_target[at]):
            if ahead < k:
                out[t] = v
                break
            ahead -= k
    return out

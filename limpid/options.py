"""What a cleaning run is allowed to do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from limpid.constants import FULL_SCAN_RATE, MAX_PASSES


@dataclass(frozen=True)
class CleaningOptions:
    """Decisions of one run.

    The two treatments that change distributions are off unless asked for (see
    `decide`); each can be limited to chosen columns, and clipping takes a threshold per column.

    `order_by` names the column that defines row order, on which the samples and
    the examples depend; without it, scan order is used. With `full_scan` no sample
    decides: a share of `full_scan_rate` of all present values does.
    """

    correct_outliers: bool | None = None
    fill_missing: bool | None = None
    outlier_columns: Sequence[str] | None = None
    missing_columns: Sequence[str] | None = None
    outlier_thresholds: Mapping[str, float] = field(default_factory=dict)
    case_columns: Sequence[str] | None = None
    max_passes: int = MAX_PASSES
    order_by: str | None = None
    full_scan: bool = False
    full_scan_rate: float = FULL_SCAN_RATE


def decide(explicit: bool | None, default: bool = False) -> bool:
    """An explicit answer wins over any diagnosis; no answer is no consent."""
    return default if explicit is None else explicit

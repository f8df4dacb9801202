"""Texts of an Arrow batch as one byte array, with places and hashes of words and lines.

Everything is computed for all texts of a piece at once; a piece is a run of whole texts of
about `PIECE` bytes, so what a task holds does not grow with its input. Only a text that is
longer than that is a piece of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SIGNS = np.ones(256, bool)  # all but digits, letters and bytes of characters beyond ASCII
SIGNS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of at most `limit` bytes or one text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = high


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): first[d] is the number of words before text d. gap: bytes between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~gap[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    begins[edges] = ink[edges]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:]
    stops[edges - 1] = ink[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(PIECE + 1, 1 << int(size).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hashes` gets the hash of any span."""
    up, _ = _table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal bytes give equal hashes wherever they stand."""
    _, down = _table(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs (or its sum of weights)."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


class Tally:
    """Counts of 64-bit keys over many pieces, handed on whenever they grow beyond a bound."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.held, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts.astype(np.int64)))
        self.size += len(keys)

    def full(self) -> bool:
        if self.size > self.most and len(self.held) > 1:
            self._merge()
        return self.size > self.most // 2 and len(self.held) == 1

    def _merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.held))
        self.held = [counted(keys, counts)]
        self.size = len(self.held[0][0])

    def batch(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        self._merge()
        keys, counts = self.held[0]
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["h", "n"])


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it is not there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class Places:
    """`find` in a table of hashes that is asked often: their leading bits tell where to look."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 1
        self.size, self.shift, self.table = len(table), np.uint64(64 - bits), np.r_[table, np.uint64(0)]
        self.start = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.start[keys >> self.shift].astype(np.int64)
        there = self.table[at]
        out = np.where((there == keys) & (at < self.size), at, -1)
        todo = np.flatnonzero((there < keys) & (at < self.size))
        at = at[todo]
        while len(todo):
            at, wanted = at + 1, keys[todo]
            there = self.table[at]
            hit = (there == wanted) & (at < self.size)
            out[todo[hit]] = at[hit]
            more = (there < wanted) & (at < self.size)
            todo, at = todo[more], at[more]
        return out


def bits_set(values: np.ndarray) -> np.ndarray:
    """Bits set in 64-bit values. Of a signed value numpy would count those of its magnitude."""
    return np.bitwise_count(values.view(np.uint64)).astype(np.int64)

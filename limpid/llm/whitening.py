"""Operator 11: whitened principal components by Chebyshev-filtered subspace iteration.

The covariance is never formed. All that the data is asked for is V·Q, a pass over the vectors
that multiplies the centred rows with a narrow block twice: in each task (X Q), then Xᵀ(X Q),
and the tasks' d x b results are added up. A few Lanczos steps bound the spectrum. Each round
then runs the three-term recurrence of a Chebyshev polynomial over such passes: it stays below
one on the unwanted part of the spectrum and grows fast above it. QR, a Rayleigh-Ritz step and
the residuals of V q - e q follow on the driver, where only d x b numbers are held. Rounds go on
until every wanted pair's residual is a rounding error of the largest eigenvalue.

Vectors are kept as blocks of integers in a table; sums and deviations are exact.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from limpid.storage import materialised

COMPONENTS = 8
GUARD = 16  # further columns of the block; the filter's cut lies at the last of them
STEPS = 8  # of Lanczos
DEGREE = 16
GROWTH = 1e12  # most that one round lets the largest direction outgrow the cut
TOLERANCE = 1e-12  # of a residual, as a share of the largest eigenvalue
ROUNDS = 60
NO_LONG = float(2**43)  # an entry of this size has no exact x
ROWS = 2048  # vectors of a block
_HALF = 1 << 32


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vector: rows that can be whitened.

    Rows go whose vector is null or holds null, NaN, an infinity or an entry of 2^43 or more,
    which has no exact integer. Of the others those stay that have the most frequent length
    (of equally frequent ones the longest); vectors of length 0 go too.
    """
    v = F.col("vector")
    fine = lambda c: F.coalesce(F.abs(c.cast("double")) < NO_LONG, F.lit(False))  # NaN is the largest double
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("vector"))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0)).filter(F.forall(v, fine))
    top = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size(v) == (top["d"] if top else 0))


def blocks(rows: DataFrame) -> DataFrame:
    """ids, n, x (n x d integers as bytes, of `width`), high and low (sums per dimension, in
    two parts) and most (largest magnitude), for up to `ROWS` vectors each."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                flat = part.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                x = (np.floor(1024 * flat) + 100000).astype(np.int64).reshape(part.num_rows, -1)
                small = x.astype(np.int32) if np.abs(x).max() < 2**31 else x
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([len(x)], pa.int64()),
                        pa.array([small.tobytes()], pa.binary()), pa.array([small.itemsize], pa.int32()),
                        pa.array([(x // _HALF).sum(0)]), pa.array([(x % _HALF).sum(0)]), pa.array([int(np.abs(x).max())]),
                    ],
                    ["ids", "n", "x", "width", "high", "low", "most"],
                )

    schema = "ids array<long>, n long, x binary, width int, high array<long>, low array<long>, most long"
    return rows.mapInArrow(run, schema)


@dataclass
class Fit:
    n: int
    sums: list[int]  # of x, per dimension
    most: int  # largest magnitude of x

    @functools.cached_property
    def wide(self) -> bool:
        """n x - S does not fit 64 bits."""
        return self.n * self.most * 2 >= 2**62

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x.astype(np.int64) * self.n - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; None beyond a long."""
        s = self.spread(x)
        if not self.wide and s.shape[1] * int(np.abs(s).max()) ** 2 < 2**63:
            return (s * s).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in s]
        return [e if e < 2**63 else None for e in exact]


def fitted(table: DataFrame) -> Fit | None:
    """Sums of all vectors; None where there are none."""
    per = table.select("n", "most", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = per.groupBy("i").agg(wide("s.high").alias("high"), wide("s.low").alias("low"), F.sum("n").alias("n"), F.max("most").alias("most"))
    found = sorted(rows.collect())  # a row per dimension
    if not found:
        return None
    return Fit(found[0]["n"], [int(r["high"]) * _HALF + int(r["low"]) for r in found], found[0]["most"])


def _each(batch: pa.RecordBatch, d: int):
    for raw, width in zip(batch.column("x"), batch.column("width")):
        yield np.frombuffer(raw.as_py(), np.int32 if width.as_py() == 4 else np.int64).reshape(-1, d)


def summed(table: DataFrame, fit: Fit, shape: tuple[int, int], partial) -> np.ndarray:
    """Sum of `partial(centred rows)` over all vectors: added up in each task, then in a shuffle
    by cell. What reaches the driver is one array of `shape`."""
    d = len(fit.sums)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for x in _each(batch, d):
                total += partial(fit.centred(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    cells = table.select("x", "width").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    got = cells.toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[got["cell"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(shape)


def times(table: DataFrame, fit: Fit, q: np.ndarray) -> np.ndarray:
    """V·Q: one pass over the vectors."""
    return summed(table, fit, q.shape, lambda x: x.T @ (x @ q)) / fit.n


@dataclass
class Components:
    vectors: np.ndarray  # [dimension, component]
    values: np.ndarray
    trace: float
    residual: float  # largest, as a share of the largest eigenvalue
    passes: int


def _bounds(product, d: int, rng, steps: int) -> tuple[float, float, float]:
    """Below the least eigenvalue, the middle, above the largest: Lanczos with full
    reorthogonalisation, widened by the last off-diagonal."""
    basis, alpha, beta = [], [], []
    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    for _ in range(min(steps, d)):
        basis.append(v)
        w = product(v[:, None])[:, 0]
        alpha.append(float(v @ w))
        for _ in range(2):
            for u in basis:
                w = w - (u @ w) * u
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-14 * max(map(abs, alpha)):
            break
        v = w / beta[-1]
    off = beta[: len(alpha) - 1]
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(off, 1) + np.diag(off, -1))
    return max(0.0, float(ritz[0]) - beta[-1]), float(np.median(ritz)), float(ritz[-1]) + beta[-1]


def _filtered(product, q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """T_degree of V, mapped so that [low, cut] is [-1, 1], times Q; scaled at `top` so that
    nothing overflows."""
    centre, half = (low + cut) / 2, (cut - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - sigma)
        before, now = now, 2 * (then / half) * (product(now) - centre * now) - sigma * then * before
        sigma = then
    return now


def leading(product, d: int, wanted: int = COMPONENTS, trace: float = 0.0, seed: int = 11) -> Components:
    """The `wanted` largest eigenpairs of the operator `product` (Q -> V·Q), or all there are.

    Eigenvalues that are rounding errors of the trace are left out. Raises where `ROUNDS` rounds
    do not bring the residuals to `TOLERANCE`.
    """
    rng, passes = np.random.default_rng(seed), 0

    def applied(q):
        nonlocal passes
        passes += 1
        return product(q)

    k, b = min(wanted, d), min(wanted + GUARD, d)
    q = np.linalg.qr(rng.standard_normal((d, b)))[0]
    if b < d:
        low, cut, top = _bounds(applied, d, rng, STEPS)
    for turn in range(ROUNDS):
        if b < d and turn and cut > low and top > cut:
            # As high a degree as keeps the block's columns apart in double precision.
            reach = math.acosh(max((2 * top - low - cut) / (cut - low), 1 + 1e-9))
            q = np.linalg.qr(_filtered(applied, q, low, cut, top, max(2, min(DEGREE, int(math.log(GROWTH) / reach)))))[0]
        vq = applied(q)
        h = q.T @ vq
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residual = np.linalg.norm(vq - q * values, axis=0)[:k].max() / max(values[0], 1e-300)
        if residual <= TOLERANCE or values[0] <= 0:
            break
        if b < d:
            cut, top = float(values[-1]), max(top, float(values[0]))
            low = low if low < 0.99 * cut else cut / 2
    else:
        raise ArithmeticError(f"no convergence in {ROUNDS} rounds: residual {residual:.1e}")
    some = values[:k] > 64 * d * np.finfo(float).eps * max(trace, values[0], 0.0)
    return Components(q[:, :k][:, some], values[:k][some], trace, float(residual), passes)


def components(table: DataFrame, fit: Fit, wanted: int = COMPONENTS) -> Components:
    trace = summed(table, fit, (1, 1), lambda x: np.full((1, 1), (x * x).sum()))[0, 0] / fit.n
    return leading(lambda q: times(table, fit, q), len(fit.sums), wanted, float(trace))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """A row per vector that `valid` keeps and component; rows that repeat are whitened each.

    There are fewer components than wanted where the covariance has a lower rank: an eigenvalue
    that is zero up to rounding has no direction to scale. A table without vectors, or
    with one distinct vector only, gives no rows.
    """
    spark = vectors.sparkSession
    table = materialised(blocks(valid(vectors, column)), "vectors")
    fit = fitted(table)
    found = components(table, fit, wanted) if fit else None
    if not found or not len(found.values):
        return spark.createDataFrame([], WHITENED)
    w = found.vectors / np.sqrt(found.values)
    k, d = len(found.values), len(fit.sums)
    moments = summed(table, fit, (k + 1, k), lambda x: np.vstack([(x @ w).T @ (x @ w), (x @ w).sum(0)])) / fit.n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    explained = found.values / found.trace

    def run(batches):
        for batch in batches:
            for ids, x in zip(batch.column("ids"), _each(batch, d)):
                n, y = len(x), fit.centred(x) @ w
                deviation = pa.array(fit.deviations(x), pa.int64())
                per = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(per)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, fit.n)), deviation.take(pa.array(per)), pa.array(y.ravel()),
                        pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error)),
                    ],
                    [c.split()[0] for c in WHITENED.split(", ")],
                )

    return table.select("ids", "x", "width").mapInArrow(run, WHITENED)


def op11_whitening(spark, folder):
    """All vectors of `embeddings`, on the first eight components."""
    return whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))

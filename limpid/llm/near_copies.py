"""Operator 6: SimHash fingerprints linked by the generalised pigeonhole principle.

The 64 bits are dealt into partitions, correlated bits together. If the thresholds of the
partitions add up to radius - partitions + 1, two fingerprints within the radius are within the
threshold of one partition at least. Thresholds may differ, and -1 leaves a partition out; a
dynamic programme picks those with the fewest expected rows and candidates. Each fingerprint
probes its partition values within the threshold; what meets is verified on all bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import documents, text_of
from limpid.storage import materialised

BITS = 64
SEED = 42
SHINGLE, RADIUS = 3, 2
SAMPLE = 4096  # fingerprints from which candidate counts are estimated; links do not depend on it
BUCKET = 256  # members up to which a bucket is compared within itself
_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8) * 256


def _majority(hashes: list[int]) -> int:
    h = np.array(hashes, np.uint64)
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (seen @ _BYTE) > len(hashes)).astype(np.uint8).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n, hashed = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return _majority([hashed(joined, SEED)])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[: n - shingle] + 1]
    return _majority([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp: a row per row of `docs`; null text has no word."""

    def run(batches):
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"),
                    pa.array([fingerprint(t, shingle) for t in raw], pa.int64()),
                ],
                ["doc_id", "text_hash", "fp"],
            )

    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return keyed.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated(fps: DataFrame) -> np.ndarray:
    """|Correlation| of each two bits over all fingerprints, added up in the tasks."""

    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            b = _bits(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
            both += (b.T @ b).astype(np.int64)
            n += len(b)
        flat = np.r_[both.ravel(), n]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    sums = np.zeros(BITS * BITS + 1)
    for r in fps.select("fp").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    n = max(sums[-1], 1)
    joint = sums[:-1].reshape(BITS, BITS) / n
    p = joint.diagonal()
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs(joint - np.outer(p, p)) / np.outer(spread, spread)


def partitions(correlation: np.ndarray, m: int, used: int | None = None) -> list[list[int]]:
    """m groups of about one size of `used` bits (all); each grows by the bit closest to those it has."""
    free, groups = np.ones(len(correlation), bool), []
    left = used or len(correlation)
    for g in range(m):
        size = left // (m - g)
        left -= size
        near = np.where(free, np.sort(np.where(free, correlation, 0), axis=1)[:, -size:].sum(1), -1)
        group = [int(near.argmax())]
        free[group] = False
        while len(group) < size:
            best = int(np.where(free, correlation[:, group].sum(1), -1).argmax())
            group.append(best)
            free[best] = False
        groups.append(sorted(group))
    return groups


def allocate(groups: list[list[int]], sample: np.ndarray, n: int, radius: int) -> tuple[float, list[int]]:
    """(expected cost, thresholds) with the least rows probed and candidates met.

    Costs per partition and threshold come from sampled pairs; the thresholds must add up to
    radius - m + 1.
    """
    bits = _bits(sample).astype(np.float32)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        b = bits[:, g]
        apart = b @ (1 - b).T
        apart = np.rint(apart + apart.T)[np.triu_indices(len(b), 1)]
        step = {}
        for done, (cost, chosen) in best.items():
            for t in range(-1, min(radius, 3) + 1):
                probes = sum(comb(len(g), i) for i in range(t + 1)) if t >= 0 else 0
                chance = max((apart <= t).mean() if len(apart) else 0.0, probes / 2.0 ** len(g)) if t >= 0 else 0.0
                more = cost + n * (probes + (t > 0)) + chance * n * n / 2
                if done + t not in step or more < step[done + t][0]:
                    step[done + t] = (more, [*chosen, t])
        best = step
    return best.get(radius - len(groups) + 1, (float("inf"), []))


def plan(fps: DataFrame, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, for the number of partitions that costs least."""
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64)
    correlation = correlated(fps)
    options = []
    for m in range(max(1, (radius + 2) // 2), radius + 2):
        groups = partitions(correlation, m)
        cost, thresholds = allocate(groups, sample, n, radius)
        options.append((cost, m, list(zip(groups, thresholds))))
    return min(options, key=lambda x: x[:2])[2]


def _signatures(fps: DataFrame, planned) -> DataFrame:
    """part, value, fp, probe: the fingerprint's own values, and those it probes besides."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = _bits(fp).astype(np.int64)
            for part, (group, t) in enumerate(planned):
                if t < 0:
                    continue
                value = bits[:, group] @ (np.int64(1) << np.arange(len(group), dtype=np.int64))
                flips = [sum(1 << i for i in c) for size in range(t + 1) for c in combinations(range(len(group)), size)]
                for flip in flips:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(fp), part, np.int32)), pa.array(value ^ np.int64(flip)),
                            pa.array(fp), pa.array(np.full(len(fp), flip != 0)),
                        ],
                        ["part", "value", "fp", "probe"],
                    )

    return fps.select("fp").mapInArrow(run, "part int, value long, fp long, probe boolean")


def _apart(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _within(buckets: DataFrame, radius: int) -> DataFrame:
    """Verified links inside buckets of at most `BUCKET` members; only links leave the task."""

    def run(batches):
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members, probing in zip(batch.column("members").to_pylist(), batch.column("probing").to_pylist()):
                own, every = np.array(members, np.int64), np.array(members + probing, np.int64)
                i, j = np.nonzero(tb.bits_set(own[:, None] ^ every[None, :]) <= radius)
                a, b = own[i], every[j]
                left.append(np.minimum(a, b)[a != b]), right.append(np.maximum(a, b)[a != b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def _hubs(fps: DataFrame, radius: int) -> DataFrame:
    """Links that connect all fingerprints of crowded buckets within the radius of each other.

    Two fingerprints within an even radius r share a value at r / 2 flipped bits or fewer from
    both, and any two that share one are within r. So each is linked to the least of those that
    share a value with it: the rows grow with the members, not with their pairs.
    """
    flips = [sum(1 << i for i in c) for size in range(radius // 2 + 1) for c in combinations(range(BITS), size)]
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for flip in flips:
                yield pa.RecordBatch.from_arrays([pa.array(fp ^ np.int64(flip)), pa.array(fp)], ["hub", "fp"])

    spokes = fps.mapInArrow(run, "hub long, fp long")
    least = spokes.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("_most")).filter("a < _most")
    return spokes.join(least, "hub").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a < b: links among distinct fingerprints, enough to connect all within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even")
    planned = plan(fps, fps.count(), radius)
    signatures = materialised(_signatures(fps, planned), "signatures")
    sizes = signatures.groupBy("part", "value").agg(
        F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own")
    ).filter("n > 1 and own > 0").select("part", "value", (F.col("n") > bucket).alias("crowded"))
    met = materialised(signatures.join(sizes, ["part", "value"]), "met")
    members = F.collect_list(F.when(~F.col("probe"), F.col("fp")))
    probing = F.collect_list(F.when(F.col("probe"), F.col("fp")))
    small = met.filter("not crowded").groupBy("part", "value").agg(members.alias("members"), probing.alias("probing"))
    found = _within(small.select("members", "probing"), radius)
    crowded = met.filter("crowded").select("fp").distinct()
    return materialised(found.unionByName(_hubs(crowded, radius)), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable), by stars: neighbours move to the least one near
    them until nothing changes. Each round is written, so no plan grows with the rounds."""
    held = materialised(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "stars")
    state = None
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialised(large.distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m")
        moved = large.join(least, F.col("u") == F.col("_u")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = materialised(moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_hash, fp, component_id: the smallest doc_id of the documents connected.

    Equal fingerprints are one node, so exact copies cost nothing. Null and empty texts have
    fingerprint 0 and are linked like any other. Null ids count for no component's smallest.
    """
    printed = materialised(fingerprints(docs, shingle), "fingerprints")
    nodes = materialised(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, bucket))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialised(rooted, "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return printed.join(named, "fp")


def op6_near_copies(spark, folder):
    g = grouped(documents(spark, folder).select("doc_id", "text"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""Operator 4: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are measures of its own bytes and words and those of the
lines before and after; the chain adds how good and bad lines follow each other. The marginals
of the forward-backward pass, weighted by the lengths of the lines, are the document's score.
Lines have no labels of their own: for learning, each takes that of its document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import documents, held_out, rows_kept, text_of
from limpid.storage import discard, materialised_alone

TRAIN_DOCUMENTS = 4000  # bound of the labelled sample: those with the smallest hashes of their ids
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-3
KEEP_AT = 0.3
_CLASSES = {
    "letters": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    "upper": [*range(0x41, 0x5B)],
    "digits": [*range(0x30, 0x3A)],
    "symbols": list(b"#*$%&|<>{}[]\\^~=_"),
    "marks": list(b".,;:?"),
    "shouts": list(b"!"),
}
FEATURES = 13


def _table(values: list[int]) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[values] = 1
    return out


_TABLES = [_table(v) for v in _CLASSES.values()]


@dataclass
class Lines:
    """Lines of several texts: own features, weights (bytes in words), and the first of each text."""

    own: np.ndarray
    weight: np.ndarray
    first: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # A line starts with its text or after a break; each text has one at least.
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[breaks + 1 < len(data)] + 1) if len(data) else np.zeros(0, np.int64)
    starts, ends, _ = tb.words(data, offsets)
    line = np.searchsorted(begin, starts, "right") - 1
    held, line = np.unique(line, return_inverse=True)  # lines with a word
    begin = begin[held]
    size = len(begin)
    words = np.bincount(line, minlength=size)
    lengths = np.bincount(line, ends - starts, size)
    short = np.bincount(line, ends - starts <= 3, size)
    hashes = tb.span_hashes(tb.prefix_sums(data), starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    echoes = np.bincount(line, again, size)
    distinct = np.unique((line.astype(np.uint64) << np.uint64(43)) | (hashes >> np.uint64(21))) >> np.uint64(43)
    distinct = np.bincount(distinct.astype(np.int64), minlength=size)
    if size:
        letters, upper, digits, symbols, marks, shouts = (np.add.reduceat(t[data], begin).astype(float) for t in _TABLES)
    else:
        letters = upper = digits = symbols = marks = shouts = np.zeros(0)
    w = np.maximum(words, 1)
    own = np.stack(
        [
            np.ones(size), np.log1p(words) / 5, lengths / w / 10, short / w, upper / np.maximum(letters, 1),
            digits / np.maximum(lengths, 1) * 5, np.minimum(symbols / w, 3), np.minimum(marks / w, 1),
            np.minimum(shouts / w, 3), 1 - distinct / w, echoes / w, letters / np.maximum(lengths, 1),
            (words < 4).astype(float),
        ],
        1,
    )
    return Lines(own, lengths, np.searchsorted(begin, offsets))


def with_neighbours(lines: Lines) -> np.ndarray:
    """Own features, and those of the line before and after in the same text (zero: none)."""
    own = lines.own
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own):
        before[1:], after[:-1] = own[:-1], own[1:]
        starts = lines.first[:-1][np.diff(lines.first) > 0]
        before[starts] = 0
        ends = lines.first[1:][np.diff(lines.first) > 0] - 1
        after[ends] = 0
    return np.concatenate([own, before, after], 1)


@dataclass
class Field:
    weights: np.ndarray  # for label good against bad
    chain: np.ndarray  # [from, to]
    slope: float = 1.0  # of the log-odds of a document's mean marginal
    shift: float = 0.0


def marginals(score: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected label pairs), all texts at once, longest first."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]
    forward = np.zeros((len(score), 2))
    backward = np.zeros((len(score), 2))
    unary = np.stack([np.zeros(len(score)), score], 1)
    for t in range(steps):
        at = starts[: alive[t]] + t
        if t == 0:
            forward[at] = unary[at]
            continue
        last = forward[at - 1]
        forward[at] = np.logaddexp(last[:, :1] + chain[0], last[:, 1:] + chain[1]) + unary[at]
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        coming = unary[at + 1] + backward[at + 1]
        both = coming[:, None, :] + chain[None]
        backward[at] = np.logaddexp(both[..., 0], both[..., 1])
        joint = forward[at][:, :, None] + both
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    gap = np.clip((forward + backward) @ np.array([1.0, -1.0]), -60, 60)
    return 1 / (1 + np.exp(gap)), pairs


def _gradient(features: np.ndarray, first: np.ndarray, labels: np.ndarray, w: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Of the likelihood by weights and chain, where every line of a text has the label of the text."""
    y = np.repeat(labels, np.diff(first)).astype(float)
    inside = np.ones(len(y), bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    seen = np.zeros((2, 2))
    same = np.flatnonzero(inside)
    np.add.at(seen, (y[same - 1].astype(int), y[same].astype(int)), 1)
    p, pairs = marginals(features @ w, first, chain)
    return np.r_[features.T @ (y - p), (seen - pairs).ravel()]


def _climbed(gradient, width: int, size: int) -> Field:
    """Penalised likelihood by Adam steps; `gradient` has that of `size` lines at weights and chain."""
    w, chain = np.zeros(width), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, ROUNDS + 1):
        step = gradient(w, chain) / max(size, 1) - RIDGE * np.r_[w, chain.ravel()]
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step**2
        step = RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, chain = w + step[:-4], chain + step[-4:].reshape(2, 2)
    return Field(w, chain)


def train(features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    return _climbed(lambda w, chain: _gradient(features, first, labels, w, chain), features.shape[1], len(features))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibrate(mean: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds at which means become probabilities of a good document."""
    return _calibrated(lambda w: _curve(mean, labels, w))


def _curve(mean: np.ndarray, labels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the likelihood: the 2 x 2 curvature, then the slope."""
    x = np.stack([_log_odds(mean), np.ones(len(mean))], 1)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
    return np.r_[((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (labels - p)]


def _calibrated(curve) -> tuple[float, float]:
    w = np.array([1.0, 0.0])
    for _ in range(50):
        sums = curve(w)
        step = np.linalg.solve(sums[:4].reshape(2, 2) + 1e-2 * np.eye(2), sums[4:] - 1e-2 * (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-12:  # further steps change nothing
            break
    return max(float(w[0]), 1e-3), float(w[1])


def document_scores(lines: Lines, field: Field, empty: float) -> np.ndarray:
    p, _ = marginals(with_neighbours(lines) @ field.weights, lines.first, field.chain)
    n = len(lines.first) - 1
    owner = np.repeat(np.arange(n), np.diff(lines.first))
    weight = np.bincount(owner, lines.weight, n)
    good = np.bincount(owner, lines.weight * p, n)
    odds = field.slope * _log_odds(good / np.maximum(weight, 1)) + field.shift
    return np.where(weight > 0, 1 / (1 + np.exp(-np.clip(odds, -60, 60))), empty)


def _allowed(labels: DataFrame) -> DataFrame:
    allowed = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality")
    return allowed.filter(~held_out("doc_id", 5, 0))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    allowed = _allowed(labels)
    ids = allowed.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    # The sample has `most` rows, so it may be broadcast.
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[Field, float]:
    """The field, and the share of good documents in the sample (the score of an empty text)."""
    schema = "own array<float>, weights array<float>, quality int"

    def run(batches):
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            quality = batch.column("quality").to_pylist()
            for low, high in tb.pieces(offsets):
                part = offsets[low : high + 1]
                x = lines_of(data[part[0] : part[-1]], part - part[0])
                own = [x.own[a:b].astype(np.float32).ravel() for a, b in zip(x.first[:-1], x.first[1:])]
                weights = [x.weight[a:b].astype(np.float32) for a, b in zip(x.first[:-1], x.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.list_(pa.float32())), pa.array(weights, pa.list_(pa.float32())),
                        pa.array(quality[low:high], pa.int32()),
                    ],
                    ["own", "weights", "quality"],
                )

    sample = _sample(docs, labels, most).withColumn("quality", F.col("quality").cast("int"))
    rows = sample.mapInArrow(run, schema).toPandas()
    if rows.empty:
        return Field(np.zeros(3 * FEATURES), np.zeros((2, 2))), 0.5
    rows = rows.sort_values(["quality"], kind="stable")
    own = [np.asarray(x, float).reshape(-1, FEATURES) for x in rows["own"]]
    first = np.r_[0, np.cumsum([len(x) for x in own])]
    lines = Lines(np.concatenate(own), np.concatenate([np.asarray(w, float) for w in rows["weights"]]), first)
    labels_of = rows["quality"].to_numpy()
    field = train(with_neighbours(lines), first, labels_of)
    plain = document_scores(lines, field, 0.5)
    field.slope, field.shift = calibrate(plain, labels_of)
    return field, float(labels_of.mean())


_TEXTS = "own binary, weights binary, first binary, quality binary"


def fit_all(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[Field, float]:
    """`fit` on all labelled documents. Where they are more than `most`, each round adds up the gradients of
    the tasks, so that the driver holds a few sums only."""
    allowed = _allowed(labels)
    if allowed.count() <= most:
        return fit(docs, labels, most)

    def run(batches):
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            quality = batch.column("quality").to_numpy().astype(np.int8)
            for low, high in tb.pieces(offsets):
                part = offsets[low : high + 1]
                x = lines_of(data[part[0] : part[-1]], part - part[0])
                columns = (x.own.astype(np.float32), x.weight.astype(np.float32), x.first.astype(np.int32), quality[low:high])
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["own", "weights", "first", "quality"])

    # The labels grow with the documents, so they are not broadcast.
    texts = docs.select("doc_id", text_of().alias("text")).join(allowed.hint("merge"), "doc_id")
    texts = texts.select("text", F.col("quality").cast("int").alias("quality"))
    table = materialised_alone(texts.mapInArrow(run, _TEXTS), "labelled-lines")
    table_of = table.coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism))

    def summed(of_rows, width: int) -> np.ndarray:
        """`of_rows` (lines, labels) -> `width` sums, added up over all rows in the order of the tasks."""

        def add(batches):
            total = np.zeros(width)
            for batch in batches:
                for own, weights, first, quality in zip(*batch.columns):
                    own, weights = (np.frombuffer(x.as_buffer(), np.float32).astype(float) for x in (own, weights))
                    first = np.frombuffer(first.as_buffer(), np.int32).astype(np.int64)
                    total += of_rows(Lines(own.reshape(-1, FEATURES), weights, first), np.frombuffer(quality.as_buffer(), np.int8).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()])], ["part", "sums"])

        rows = table_of.mapInArrow(add, "part long, sums array<double>").collect()  # a row per task
        return sum((np.array(r["sums"]) for r in sorted(rows, key=lambda r: r["part"])), np.zeros(width))

    n_lines, n_texts, good = summed(lambda lines, y: np.array([len(lines.own), len(y), y.sum()], float), 3)
    if not n_texts:
        return Field(np.zeros(3 * FEATURES), np.zeros((2, 2))), 0.5
    field = _climbed(
        lambda w, chain: summed(lambda lines, y: _gradient(with_neighbours(lines), lines.first, y, w, chain), 3 * FEATURES + 4),
        3 * FEATURES, int(n_lines),
    )
    field.slope, field.shift = _calibrated(
        lambda w: summed(lambda lines, y: _curve(document_scores(lines, field, 0.5), y, w), 6)
    )
    discard(table)
    return field, float(good / n_texts)


def scored(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of `docs`, in one pass without a shuffle.

    An empty or null text, or one without a word, has the share of good documents as its score.
    Without any label the score is 0.5.
    """
    field, empty = fit(docs, labels, most)
    schema = "doc_id long, held_out boolean, score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast((field, empty))

    def run(batches):
        learnt, default = shared.value
        for batch in batches:
            score = scores_of(batch.column("text"), learnt, default)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score),
                    pa.array((score >= KEEP_AT).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text").mapInArrow(run, schema)


def scores_of(texts, field: Field, empty: float) -> np.ndarray:
    data, offsets = tb.texts(texts)
    out = np.zeros(len(offsets) - 1)
    for low, high in tb.pieces(offsets):
        part = offsets[low : high + 1]
        out[low:high] = document_scores(lines_of(data[part[0] : part[-1]], part - part[0]), field, empty)
    return out


def kept(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least `KEEP_AT`, learnt from all labelled documents."""
    field, empty = fit_all(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast((field, empty))

    def run(batches):
        learnt, default = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(scores_of(text, learnt, default) >= KEEP_AT))

    return rows_kept(docs, run)


def op4_line_quality(spark, folder):
    return scored(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))

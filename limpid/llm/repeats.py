"""Operator 1: bytes of strings that also start elsewhere, by run-length indexes.

A string of `length` bytes is keyed by the smallest hash of its `K`-byte parts, so equal
strings have equal keys. Neighbouring strings of a text with one key form a run. A key that
only one run has, and whose part stands there once, is done with. Runs that are equal as a whole are one entry, and all strings of
an entry with several owners repeat. Where a key has different runs, their texts are indexed
together: suffix order, its Burrows-Wheeler transform cut into runs of equal letters, and the
text places sampled at the run ends. Matching statistics follow from the samples alone: going
left from a sampled pair, the common length grows by one per letter until the letters differ,
which is the next run end. So a sampled pair with a common length of `length` or more marks
every long match that ends where it ends, and no other pair needs to be looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import documents, text_of
from limpid.storage import materialised

LENGTH = 400
K = 128
RUN = 4096  # strings in a run at most; a longer one is several runs
INDEX = 1 << 19  # bytes indexed together
HOT = 6 << 20  # bytes of one key's different runs beyond which its strings are counted by hash
BUCKETS = 1 << 20

_RUNS = "doc_id long, text_hash long, h long, digest long, a long, b long, inner boolean"


def _least(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Smallest (or what `pick` picks) of each `width` neighbours, by windows of doubled width."""
    span, low = 1, values
    while span * 2 <= width:
        low = pick(low[: len(low) - span], low[span:])
        span *= 2
    if rest := width - span:
        low = pick(low[: len(low) - rest], low[rest:])
    return low


def _several(parts: np.ndarray, keys: np.ndarray, begin: np.ndarray, stop: np.ndarray, key: np.ndarray, width: int):
    """Whether a run holds its key's part at more than one place, as only then may strings of
    one run be equal."""
    around = np.r_[np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)]
    at = np.flatnonzero(_least(around, width, np.maximum)[: len(parts)] == parts)  # smallest of some string
    values, number = np.unique(parts[at], return_inverse=True)
    ranked = np.sort(number * len(parts) + at)
    own = np.searchsorted(values, key) * len(parts)
    low = np.searchsorted(ranked, own + begin, "left")
    return np.searchsorted(ranked, own + stop + width - 1, "right") - low > 1


def string_runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int, most: int):
    """(text, first, last, key, inner) of each run of strings, places in the texts' bytes."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    if len(data) < length:
        return none
    sums = tb.prefix_sums(data)
    places = np.arange(len(data) - k + 1)
    parts, width = tb.span_hashes(sums, places, places + k), length - k + 1
    keys = _least(parts, width)
    sizes = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int32)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid)[: len(keys)] > 0)
    if not len(at):
        return none
    key = keys[at]
    owner = np.searchsorted(offsets, at, "right") - 1
    new = np.r_[True, (np.diff(at) != 1) | (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    start = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    start = np.flatnonzero(since % most == 0)
    end = np.r_[start[1:], len(at)] - 1
    owner, key = owner[start], key[start]
    inner = _several(parts, keys, at[start], at[end], key, width)
    return owner, at[start] - offsets[owner], at[end] - offsets[owner], key, inner


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))


def runs_of(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """A row per run: text, key, digest of its bytes, first and last string start."""

    def run(batches):
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            for low, high in tb.pieces(offsets):
                part = offsets[low : high + 1]
                piece = data[part[0] : part[-1]]
                owner, a, b, key, inner = string_runs(piece, part - part[0], length, k, RUN)
                if not len(owner):
                    continue
                begin = (part - part[0])[owner] + a
                stop = (part - part[0])[owner] + b + length
                raw = piece.tobytes()
                digest = b"".join(
                    hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in zip(begin.tolist(), stop.tolist())
                )
                rows = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()).take(rows), batch.column("text_hash").take(rows),
                        pa.array(key.view(np.int64)), pa.array(np.frombuffer(digest, np.int64)),
                        pa.array(a), pa.array(b), pa.array(inner),
                    ],
                    [c.split()[0] for c in _RUNS.split(", ")],
                )

    return _keyed(docs).filter(F.octet_length("text") >= length).mapInArrow(run, _RUNS)


def suffix_order(data: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes, each ending with its own text; equal ones in text order.

    left: bytes from each place to the end of its text. Ranks of 7 bytes first, then of doubled
    lengths; a suffix that ends earlier comes first.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    held = np.minimum(left, 7)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(8)) | np.where(held > i, padded[i : i + n], np.uint64(0))
    key = (key << np.uint64(8)) | held.astype(np.uint64)
    step = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        if step >= longest or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        after = np.zeros(n, np.uint64)
        goes_on = np.flatnonzero(left > step)
        after[goes_on] = rank[goes_on + step]
        key = (rank << np.uint64(32)) | after
        step *= 2


def _common(data: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, up to `most`."""
    same = np.zeros(len(x), np.int64)
    todo = np.flatnonzero(most > 0)
    padded = np.r_[data, np.zeros(16, np.uint8)]
    lane = np.arange(16)
    while len(todo):
        at = same[todo]
        equal = padded[(x[todo] + at)[:, None] + lane] == padded[(y[todo] + at)[:, None] + lane]
        whole = equal.all(1)
        same[todo] = np.minimum(at + np.where(whole, 16, equal.argmin(1)), most[todo])
        todo = todo[whole & (same[todo] < most[todo])]
    return same


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, whether the string of `length` bytes at each place also starts elsewhere
    in these texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(len(data))
    order = suffix_order(data, left, int(sizes.max()))
    # The letter before each suffix; before a text's first there is none like it.
    before = np.r_[0, data[:-1]].astype(np.int32)
    before[begins] = -1 - np.arange(len(texts))
    bwt = before[order]
    heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # run starts; the row above is a run end
    x, y = order[heads], order[heads - 1]
    shared = np.minimum(left[x], left[y])
    long = shared >= length
    x, y, shared = x[long], y[long], shared[long]
    common = _common(data, x, y, shared)
    hit = common >= length
    delta = np.zeros(len(data) + 1, np.int64)
    for at in (x[hit], y[hit]):
        np.add.at(delta, at, 1)
        np.add.at(delta, at + common[hit] - length + 1, -1)
    marked = np.cumsum(delta[:-1]) > 0
    return [marked[b : e] for b, e in zip(begins.tolist(), ends.tolist())]


def _stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[0, marked.astype(np.int8), 0]))
    return edges[::2], edges[1::2]


_MARKS = "doc_id long, text_hash long, start long, stop long"


def _index(passages: DataFrame, length: int) -> DataFrame:
    """Marks of runs by the indexes of their keys. Rows come by key; whole keys are gathered up
    to `INDEX` bytes and indexed together, since strings of different keys never match."""

    def run(batches):
        held, size, last = [], 0, None

        def marks():
            found = repeated_starts([p for *_, p in held], length)
            ids, hashes, starts, stops = [], [], [], []
            for (doc, text, n, a, _), marked in zip(held, found):
                if n > 1:
                    continue  # all its strings repeat already
                for s, e in zip(*_stretches(marked)):
                    ids.append(doc), hashes.append(text)
                    starts.append(a + int(s)), stops.append(a + int(e) - 1 + length)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()), "text_hash": pa.array(hashes, pa.int64()),
                    "start": pa.array(starts, pa.int64()), "stop": pa.array(stops, pa.int64()),
                }
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("h", "doc_id", "text_hash", "n", "a", "passage")]
            for h, *row in zip(*columns):
                if h != last and size >= INDEX:
                    yield marks()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = h
        if held:
            yield marks()

    return passages.repartition("h").sortWithinPartitions("h").mapInArrow(run, _MARKS)


def _hashed(passages: DataFrame, length: int) -> DataFrame:
    """Marks of the runs of very frequent keys: their strings are counted by hash, which splits
    such a key over all tasks."""

    def run(batches):
        for batch in batches:
            for h, digest, n, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "digest", "n", "passage"))):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                w = tb.span_hashes(tb.prefix_sums(data), at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), h)), pa.array(np.full(len(at), digest)), pa.array(at),
                        pa.array(w.view(np.int64)), pa.array(np.full(len(at), n)),
                    ],
                    ["h", "digest", "at", "w", "n"],
                )

    strings = passages.select("h", "digest", "n", "passage").mapInArrow(run, "h long, digest long, at long, w long, n long")
    strings = materialised(strings, "strings")
    again = strings.groupBy("h", "w").agg(F.sum("n").alias("_n")).filter("_n > 1").select("h", "w")
    owners = passages.filter("n = 1").select("h", "digest", "doc_id", "text_hash", "a")
    hits = strings.filter("n = 1").join(again, ["h", "w"]).select("h", "digest", "at").join(owners, ["h", "digest"])
    start = F.col("a") + F.col("at")
    return hits.select("doc_id", "text_hash", start.alias("start"), (start + length).alias("stop"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS))


def _split(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that may be wanted, the others): only the first have to be shuffled. What is
    broadcast are hash buckets of the wanted ones, `BUCKETS` numbers at most."""
    buckets = F.broadcast(wanted.select(_bucket().alias("_bucket")).distinct())
    d = docs.withColumn("_bucket", _bucket())
    return d.join(buckets, "_bucket", "left_semi").drop("_bucket"), d.join(buckets, "_bucket", "left_anti").drop("_bucket")


def _joined(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    other = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), column)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return docs.join(other, same, how).drop("_id", "_hash")


def _passages(docs: DataFrame, entries: DataFrame, length: int) -> DataFrame:
    """The bytes of each entry's run, cut from its owner's text."""
    wanted = entries.select("doc_id", "text_hash", F.struct("h", "digest", "n", "a", "b", "hot").alias("e"))
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("e").alias("entries"))
    some, _ = _split(_keyed(docs), lists)
    schema = "doc_id long, text_hash long, h long, digest long, n long, a long, hot boolean, passage binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"hot": pa.bool_(), "passage": pa.binary()}

    def run(batches):
        for batch in batches:
            out = {c: [] for c in names}
            columns = [batch.column(c) for c in ("doc_id", "text_hash", "text", "entries")]
            for doc, text_hash, text, found in zip(*(c.to_pylist() for c in columns)):
                raw = text.encode()
                for e in found:
                    row = (doc, text_hash, e["h"], e["digest"], e["n"], e["a"], e["hot"], raw[e["a"] : e["b"] + length])
                    for c, v in zip(names, row):
                        out[c].append(v)
                if len(out["h"]) >= 2000:
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})
                    out = {c: [] for c in names}
            if out["h"]:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})

    # Of rows equal in id and text, each gives the passage; their entries have n > 1, which
    # one more does not change.
    return _joined(some, lists, "entries", "inner").mapInArrow(run, schema)


def marks(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, start, stop (bytes): stretches to remove; they may overlap."""
    runs = materialised(runs_of(docs, length, k), "runs")
    keys = runs.groupBy("h").agg(
        F.count("*").alias("_n"), F.min("digest").alias("_low"), F.max("digest").alias("_high"),
        F.max("inner").alias("_inner"),
    ).filter("_n > 1 or _inner").select("h", (F.col("_inner") | (F.col("_low") != F.col("_high"))).alias("differ"))
    shared = materialised(runs.drop("inner").join(keys, "h"), "shared-runs")
    entries = shared.groupBy("h", "digest").agg(
        F.count("*").alias("n"), F.first("differ").alias("differ"),
        F.min(F.struct("doc_id", "text_hash", "a", "b")).alias("owner"),
    )
    entries = materialised(entries.select("h", "digest", "n", "differ", "owner.*"), "entries")
    whole = shared.join(entries.filter("n > 1").select("h", "digest"), ["h", "digest"], "left_semi").select(
        "doc_id", "text_hash", F.col("a").alias("start"), (F.col("b") + length).alias("stop")
    )
    differ = entries.filter("differ")
    sizes = differ.groupBy("h").agg((F.sum(F.col("b") - F.col("a") + length) > hot).alias("hot"))
    passages = materialised(_passages(docs, differ.join(sizes, "h"), length), "passages")
    found = whole.unionByName(_index(passages.filter("not hot"), length))
    if passages.filter("hot").take(1):
        found = found.unionByName(_hashed(passages.filter("hot"), length))
    return found


def _cut(docs: DataFrame, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text

    def run(batches):
        for batch in batches:
            out = {c.split()[0]: [] for c in schema.split(", ")}
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw, kept, at, removed, n = text.encode(), [], 0, 0, 0
                for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if s[0] > at or n == 0:
                        kept.append(raw[at : s[0]])
                        removed, n, at = removed + s[1] - s[0], n + 1, s[1]
                    elif s[1] > at:
                        removed, at = removed + s[1] - at, s[1]
                kept = b"".join([*kept, raw[at:]])
                row = (doc, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"))
                for c, v in zip(out, row):
                    out[c].append(v)
            texts = ("kept_sha256", "text")
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c in texts else pa.int64()) for c, v in out.items()})

    return docs.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """Each document without its repeated strings: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, if wanted, the text left (bytes of a character cut in two are dropped).

    Null text is empty. A row that occurs twice is two documents, so both lose what is long
    enough. Texts shorter than `length` bytes keep all.
    """
    found = materialised(marks(docs, length, k, hot), "marks")
    lists = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    some, others = _split(_keyed(docs), found)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    columns = ("doc_id", "text", "spans")
    joined = _joined(some, lists, "spans", "left").select(*columns)
    return _cut(joined.unionByName(others.withColumn("spans", none).select(*columns)), with_text)


def op1_repeats(spark, folder):
    return without_repeats(documents(spark, folder).select("doc_id", "text"), with_text=False)

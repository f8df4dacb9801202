"""Operator 13: collocations by SON partitioning.

The corpus is dealt into `SHARDS` shards of whole tasks. A phrase with `support` occurrences has
its proportional share of them in at least one shard. Each shard is mined completely at that
lowered support, level by level: a phrase can be frequent only if both phrases one word
shorter are. What is frequent in any shard is a candidate; all candidates are then counted over
the whole corpus, which is exact. Where there are more candidates than may be sent to all tasks,
the phrases of a level are counted over the whole corpus at once, behind a bitmap of fixed size
that drops those with a part that cannot be frequent.

The number of shards does not grow with the corpus, or the lowered support would sink to one
occurrence. So a shard may be larger than a task: counts of a level are added up by shard in a
shuffle, from the tasks' own sums. Mined are only words that have `support` occurrences
in the corpus; a first count finds them, and texts are kept from then on as their numbers.

A phrase is the pair of its front's number and its last word's, or all its words' numbers. Hashes
deal phrases out and sort them, but phrases are told apart by their numbers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import LOWER, UPPER, documents, text_of
from limpid.llm.language_model import _bits, _cuts, _joined as _with_word, _maybe, _packed, _steps, _unpacked, bitmap
from limpid.operators.sampling import first_n_per_group
from limpid.storage import materialised, materialised_alone

SUPPORT = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
SHARDS = 8
CHUNK = 8 << 20  # bytes of texts whose words a task numbers at once
PIECE = 1 << 20
ROW = 1 << 20  # words of an encoded row, which are counted at once
MOST = 1_000_000
BLOCK = 4096  # candidates whose counts go out as one array
SPREAD = 64
_END = -1  # between two pieces

#: A-Z to a-z, tab to blank, and what ends a piece to a line end.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if chr(c) in ".,;:!?\n\v\f\r" else c for c in range(256)
)


# --- words of texts -----------------------------------------------------------------------


class Chunk:
    """Words of some whole texts by language, as numbers; `_END` stands between pieces. `words` are those of the
    language that `languages` is at."""

    def __init__(self):
        self.size, self.words, self.parts = 0, [], {}

    def add(self, lang: str, texts: list[bytes]) -> None:
        self.size += sum(map(len, texts))
        self.parts.setdefault(lang, []).append(b"\n".join(texts).translate(_FOLD))

    def languages(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang in list(self.parts):
            folded = b"\n".join([*self.parts.pop(lang), b""]).replace(b"\n", b" \n ")
            tokens = pc.split_pattern(pa.array([folded], pa.large_binary()), b" ").flatten()
            coded = pc.dictionary_encode(tokens.filter(pc.greater(pc.binary_length(tokens), 0)))
            self.words = coded.dictionary.to_pylist()
            numbers = np.arange(len(self.words), dtype=np.int32)
            numbers[self.words.index(b"\n")] = _END
            yield lang, numbers[coded.indices.to_numpy()]


def frequent(words: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: (a place of each phrase, its count)."""
    places = np.flatnonzero(words >= 0).astype(np.int32)
    keys = words[places].astype(np.int64)
    for n in range(1, longest + 1):
        if not len(places):
            return
        order, starts, counts = _groups(keys)
        yield places[order[starts]], counts
        ids = np.full(len(words) + 1, -1, np.int32)
        ids[places[order]] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        places = places[: np.searchsorted(places, len(words) - n)]
        places = places[words[places + n] >= 0]
        keys = (ids[places].astype(np.int64) << 32) | words[places + n]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, where each distinct key starts in it, and how often it occurs."""
    order = np.argsort(keys)
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return order, starts, np.diff(starts, append=len(order))


def _texts(chunk: Chunk, words: np.ndarray, places: np.ndarray, n: int) -> list[bytes]:
    rows = words[places[:, None] + np.arange(n)]
    return [b" ".join([chunk.words[i] for i in row]) for row in rows.tolist()]


def _chunks(batches, size: int) -> Iterator[Chunk]:
    """Runs of whole texts; a text is never divided."""
    chunk = Chunk()
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        n = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            raw = text.as_py()
            if not raw:
                continue
            held.setdefault(lang, []).append(raw)
            n += len(raw)
            if n >= PIECE or chunk.size + n >= size:
                for k, v in held.items():
                    chunk.add(k, v)
                held, n = {}, 0
            if chunk.size >= size:
                yield chunk
                chunk = Chunk()
        for k, v in held.items():
            chunk.add(k, v)
    if chunk.size:
        yield chunk


def _batch(schema: str, *columns) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*[f.split() for f in schema.split(", ")])
    arrays = [
        pa.array(c, pa.binary()).cast(pa.string(), safe=False) if k == "string" else pa.array(c, types[k])
        for c, k in zip(columns, kinds)
    ]
    return pa.RecordBatch.from_arrays(arrays, list(names))


COUNTED = "lang string, phrase string, k int, f long"


def all_phrases(docs: DataFrame, longest: int, size: int = CHUNK) -> DataFrame:
    """lang, phrase, k, f: every phrase of 1 to `longest` words. Sums of chunks, then a shuffle."""

    def run(batches):
        for chunk in _chunks(batches, size):
            for lang, words in chunk.languages():
                for k, (places, counts) in enumerate(frequent(words, longest), 1):
                    for low in range(0, len(places), 1 << 16):
                        part = slice(low, low + (1 << 16))
                        texts = _texts(chunk, words, places[part], k)
                        yield _batch(COUNTED, [lang.encode()] * len(texts), texts, [k] * len(texts), counts[part])

    sums = docs.select("lang", "text").mapInArrow(run, COUNTED)
    return sums.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


# --- shards -------------------------------------------------------------------------------


ENCODED = "shard int, lang string, bytes long, words binary"


@dataclass
class Vocabulary:
    """Per language the frequent words, in order of their numbers."""

    words: dict[str, list[str]]

    @functools.cached_property
    def numbers(self) -> dict[str, dict[bytes, int]]:
        return {lang: {w.encode(): i for i, w in enumerate(ws)} for lang, ws in self.words.items()}


def encoded(docs: DataFrame, vocabulary: Vocabulary, shards: int = SHARDS, size: int = CHUNK) -> DataFrame:
    """Rows of about `ROW` words of a language: their numbers, -1 for other words and between pieces.
    `bytes` adds up to those of all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.words)

    def run(batches):
        numbers = Vocabulary(shared.value).numbers
        shard = TaskContext.get().partitionId() % shards
        held: dict[str, list[np.ndarray]] = {}
        n_bytes = 0

        def row(lang):
            nonlocal n_bytes
            out = _batch(ENCODED, [shard], [lang.encode()], [n_bytes], [np.concatenate(held.pop(lang)).tobytes()])
            n_bytes = 0
            return out

        for chunk in _chunks(batches, size // 2):
            n_bytes += chunk.size
            for lang, words in chunk.languages():
                known = numbers.get(lang, {})
                mine = np.array([known.get(w, -1) for w in chunk.words] + [-1], np.int32)[words]
                held.setdefault(lang, []).append(mine)
                if sum(map(len, held[lang])) >= ROW:
                    yield row(lang)
        for lang in list(held):
            yield row(lang)

    return docs.select("lang", "text").mapInArrow(run, ENCODED)


def local_supports(table: DataFrame, support: int) -> dict[int, int]:
    """Per shard, its share by bytes of the support, rounded up."""
    sizes = {r["shard"]: r["n"] for r in table.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    total = max(sum(sizes.values()), 1)
    return {shard: max(1, -(-support * n // total)) for shard, n in sizes.items()}


class Trie:
    """Candidates by language: at each length from 2 the sorted pairs (front << 32 | last word).
    A phrase's number is its pair's place there; a word's is that of the vocabulary."""

    def __init__(self):
        self.levels: dict[str, list[np.ndarray]] = {}

    def extend(self, found: pa.Table, k: int) -> None:
        """The candidates of `k` words, from columns lang and key."""
        keys = found.column("key").to_numpy()
        langs = np.array(found.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            self.levels.setdefault(lang, []).append(np.sort(keys[langs == lang]))

    def size(self) -> int:
        return sum(len(level) for levels in self.levels.values() for level in levels)

    def walk(self, lang: str, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, keys) of the phrases of each length, from 2, whose front and back are
        candidates; one length more than the trie has. Fronts are looked up as it goes."""
        places = np.flatnonzero(words[:-1] >= 0).astype(np.int32)
        places = places[words[places + 1] >= 0]
        keys = (words[places].astype(np.int64) << 32) | words[places + 1]
        yield 2, places, keys
        for k, level in enumerate(self.levels.get(lang, []), 2):
            numbers = tb.find(level, keys)
            ids = np.full(len(words) + 1, -1, np.int32)
            ids[places] = numbers
            places = places[(numbers >= 0) & (places < len(words) - k)]
            places = places[(ids[places + 1] >= 0) & (words[places + k] >= 0)]
            keys = (ids[places].astype(np.int64) << 32) | words[places + k]
            yield k + 1, places, keys

    def phrase(self, lang: str, k: int, number: int, words: list[str]) -> str:
        out = []
        for level in reversed(self.levels[lang][: k - 1]):
            pair = int(level[number])
            out.append(words[pair & 0xFFFFFFFF])
            number = pair >> 32
        return " ".join([words[number], *reversed(out)])


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The named columns and the words of each row, one row at a time."""
    for *values, raw in zip(*[batch.column(c) for c in (*names, "words")]):
        yield *[v.as_py() for v in values], np.frombuffer(raw.as_buffer(), np.int32)


LEVEL = "shard int, lang string, key long, n long"
DEALT = "bucket int, shard int, lang string, data binary"


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = _with_word(h, c.astype(np.uint64))
    return h


def _summed(h: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> tuple:
    """Hashes, numbers and counts of the distinct phrases, by hash. Phrases of one hash stay apart."""
    if not len(h):
        return h, columns, n
    order = np.argsort(h)
    h, columns = h[order], [c[order] for c in columns]
    same = h[1:] == h[:-1]
    if any((c[1:] != c[:-1])[same].any() for c in columns):
        again = np.lexsort([*columns, h])
        order, columns = order[again], [c[again] for c in columns]
    new = np.r_[True, ~same | np.any([c[1:] != c[:-1] for c in columns], axis=0)]
    return h[new], [c[new] for c in columns], np.add.reduceat(n[order], np.flatnonzero(new))


def _dealt(table: DataFrame, phrases, width: int, bits: int) -> DataFrame:
    """The phrases of each row of words, as `width` columns of numbers and their counts, dealt by hash into packed rows."""

    def run(batches):
        for batch in batches:
            for shard, lang, words in _rows(batch, "shard", "lang"):
                columns = phrases(lang, words)
                h, columns, n = _summed(_hashed(columns), columns, np.ones(len(columns[0]), np.int64))
                cuts = list(_cuts(h, bits))
                data = []
                for _, low, high in cuts:
                    part = [c[low:high] for c in columns]
                    order = np.argsort((part[0].astype(np.int64) << 32) | part[1])
                    part = [part[0][order].view(np.uint32), *(c[order] for c in part[1:]), n[low:high][order]]
                    data.append(_packed(_steps(part[0]), *part[1:]))
                if cuts:
                    yield _batch(DEALT, [b for b, *_ in cuts], [shard] * len(cuts), [lang.encode()] * len(cuts), data)

    return table.select("shard", "lang", "words").mapInArrow(run, DEALT)


def _collected(rows: pa.Table, width: int) -> tuple:
    """The sums of packed rows."""
    held = []
    for data in rows.column("data"):
        first, *others = _unpacked(data, np.uint32, *[np.int32] * (width - 1), np.int64)
        held.append([np.cumsum(first, dtype=np.uint32).view(np.int32), *others])
    *columns, n = (np.concatenate(x) for x in zip(*held))
    return _summed(_hashed(columns), columns, n)


def _groups_of(rows: pa.Table, *names: str) -> Iterator[tuple[tuple, pa.Table]]:
    values = list(zip(*(rows.column(c).to_pylist() for c in names)))
    for value in sorted(set(values)):
        yield value, rows.filter(pa.array([v == value for v in values]))


def frequent_in_shards(table: DataFrame, trie: Trie, k: int, supports: dict[int, int], bits: int = 4) -> DataFrame:
    """shard, lang, key, n: the phrases of `k` words that are frequent in a shard.

    `trie` has the candidates of up to k - 1 words. Each task sends its own sums, in 2^bits buckets.
    """
    shared = table.sparkSession.sparkContext.broadcast(trie)

    def phrases(lang, words):
        keys = next((keys for n, _, keys in shared.value.walk(lang, words) if n == k), np.zeros(0, np.int64))
        return [(keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)]

    def added(rows):
        out = []
        for (shard, lang), some in _groups_of(rows, "shard", "lang"):
            _, (front, last), n = _collected(some, 2)
            front, last, n = (x[n >= supports[shard]] for x in (front, last, n))
            keys = (front.astype(np.int64) << 32) | last
            out.append(_batch(LEVEL, [shard] * len(n), [lang.encode()] * len(n), keys, n))
        return pa.Table.from_batches(out)

    return _dealt(table, phrases, 2, bits).groupBy("bucket").applyInArrow(added, LEVEL)


FREQUENT = "lang string, h long, words binary, f long"


def frequent_everywhere(table: DataFrame, k: int, shorter: np.ndarray | None, support: int, bits: int) -> DataFrame:
    """lang, h, words, f: the phrases of `k` words with `support` occurrences, as their words' numbers.

    `shorter` is a bitmap of the phrases of k - 1 words that are frequent, for k above 2.
    """
    shared = table.sparkSession.sparkContext.broadcast(shorter)

    def phrases(lang, words):
        n = max(0, len(words) - k + 1)
        whole = words >= 0
        for i in range(1, k):
            whole = whole[:-1] & (words[i:] >= 0) if len(whole) > 1 else whole[:0]
        places = np.flatnonzero(whole[:n])
        for back in (0, 1) if k > 2 else ():
            part = [words[places + back + i] for i in range(k - 1)]
            places = places[_maybe(shared.value, _hashed(part))]
        return [words[places + i] for i in range(k)]

    def added(rows):
        out = []
        for (lang,), some in _groups_of(rows, "lang"):
            h, columns, f = _collected(some, k)
            often = f >= support
            words = np.ascontiguousarray(np.stack([c[often] for c in columns], 1))
            words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * k), len(words), [None, pa.py_buffer(words)]).cast(pa.binary())
            out.append(_batch(FREQUENT, [lang.encode()] * len(words), h[often].view(np.int64), words, f[often]))
        return pa.Table.from_batches(out)

    return _dealt(table, phrases, k, bits).groupBy("bucket").applyInArrow(added, FREQUENT)


def level_counts(table: DataFrame, vocabulary: Vocabulary, support: int, longest: int, bits: int) -> DataFrame | None:
    """lang, phrase, k, f of the phrases of 2 words and more with `support` occurrences; None if there is none."""
    shared = table.sparkSession.sparkContext.broadcast(vocabulary.words)
    shorter, out = None, None

    def spelt(batches):
        for batch in batches:
            langs, ids = batch.column("lang").to_pylist(), [np.frombuffer(w, np.int32).tolist() for w in batch.column("words").to_pylist()]
            phrases = [" ".join([shared.value[lang][i] for i in row]).encode() for lang, row in zip(langs, ids)]
            yield _batch(COUNTED, [lang.encode() for lang in langs], phrases, [len(row) for row in ids], batch.column("f").to_numpy())

    for k in range(2, longest + 1):
        found = materialised_alone(frequent_everywhere(table, k, shorter, support, bits), "frequent-phrases")
        if found.isEmpty():
            break
        part = found.mapInArrow(spelt, COUNTED)
        out = part if out is None else out.unionByName(part)
        if k < longest:
            shorter = bitmap(found)
    return out


TALLY = "lang string, k int, block int, part int, f array<long>"


def _tally_row(lang: str, k: int, block: int, part: int, f: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang]), pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32())]
    values = pa.ListArray.from_arrays(pa.array([0, len(f)], pa.int32()), pa.array(f, pa.int64()))
    return pa.RecordBatch.from_arrays([*columns, values], ["lang", "k", "block", "part", "f"])


def _added(keys: tuple, rows: pa.Table) -> pa.Table:
    total = sum(v.values.to_numpy() for v in rows.column("f"))
    lang, k, block, *part = (key.as_py() for key in keys)
    return pa.Table.from_batches([_tally_row(lang, k, block, part[0] if part else 0, total)])


def counted(table: DataFrame, trie: Trie) -> DataFrame:
    """lang, k, number, f: occurrences of every candidate in the whole corpus.

    A task's counts go out as arrays, one per `BLOCK` numbers, and are added up as such: by
    `SPREAD` groups of tasks, then altogether.
    """
    shared = table.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        sums: dict = {}
        part = TaskContext.get().partitionId() % SPREAD
        for batch in batches:
            for lang, words in _rows(batch, "lang"):
                levels = shared.value.levels.get(lang, [])
                for k, _, keys in shared.value.walk(lang, words):
                    if k - 2 == len(levels):
                        break
                    at = tb.find(levels[k - 2], keys)
                    tally = np.bincount(at[at >= 0], minlength=len(levels[k - 2]))
                    sums[lang, k] = sums[lang, k] + tally if (lang, k) in sums else tally
        for (lang, k), tally in sums.items():
            for low in range(0, len(tally), BLOCK):
                if tally[low : low + BLOCK].any():
                    yield _tally_row(lang, k, low // BLOCK, part, tally[low : low + BLOCK])

    sums = table.select("lang", "words").mapInArrow(run, TALLY)
    sums = sums.groupBy("lang", "k", "block", "part").applyInArrow(_added, TALLY)
    sums = sums.groupBy("lang", "k", "block").applyInArrow(_added, TALLY)
    each = sums.select("lang", "k", "block", F.posexplode("f").alias("at", "f"))
    return each.select("lang", "k", (F.col("block").cast("long") * BLOCK + F.col("at")).alias("number"), "f")


def son_counts(
    docs: DataFrame, words: DataFrame, support: int, longest: int, shards: int, size: int, most: int
) -> DataFrame | None:
    """lang, phrase, k, f of all phrases with `support` occurrences, words included; None where
    the words are more than `most`, which is what may be sent to all tasks. With more candidates
    than that, `level_counts` has the same."""
    spark = docs.sparkSession
    if words.count() > most:
        return None
    rows = words.select("lang", "phrase", "f").collect()
    vocabulary = Vocabulary({})
    for r in sorted(rows):
        vocabulary.words.setdefault(r["lang"], []).append(r["phrase"])
    table = materialised(encoded(docs, vocabulary, shards, size), "encoded")
    supports = local_supports(table, support)
    bits = _bits(sum(r["f"] for r in rows))
    trie = Trie()
    for k in range(2, longest + 1):
        if not supports:
            break
        found = frequent_in_shards(table, trie, k, supports, bits).select("lang", "key").distinct()
        found = materialised_alone(found, "candidates")
        n = found.count()
        if trie.size() + n > most:
            more = level_counts(table, vocabulary, support, longest, bits)
            return words.select("lang", "phrase", "k", "f") if more is None else words.select("lang", "phrase", "k", "f").unionByName(more)
        if not n:
            break
        trie.extend(found.toArrow(), k)
    sums = counted(table, trie).filter(F.col("f") >= support).toArrow().to_pylist()  # of candidates, `most` at most
    phrases = [(r["lang"], trie.phrase(r["lang"], r["k"], r["number"], vocabulary.words[r["lang"]]), r["k"], r["f"]) for r in sums]
    phrases += [(r["lang"], r["phrase"], 1, r["f"]) for r in rows]
    lang, phrase, k, f = zip(*phrases) if phrases else ((),) * 4
    columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(f, pa.int64())]
    return spark.createDataFrame(pa.table(columns, ["lang", "phrase", "k", "f"]))


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def ranked(counts: DataFrame, totals: DataFrame, support: int, top: int) -> DataFrame:
    """Scores, absorbed phrases and ranks. `counts` has every phrase with `support` occurrences
    and all their parts; `totals` has lang and n.

    A phrase inside a longer one that is as frequent goes. Whatever lies between the two is as
    frequent too, so it is enough to look at phrases one word longer.
    """
    phrases = counts.filter((F.col("k") >= 2) & (F.col("f") >= support)).withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    longer = phrases.filter("k > 2").select(
        "lang", F.col("a").alias("around"),
        F.explode(F.array(_joined(words, 1, F.col("k") - 1), _joined(words, 2, F.col("k") - 1))).alias("phrase"),
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter("around is null or around < a").drop("around")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", _joined(words, 1, F.col("cut")).alias("left"),
        _joined(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"),
    )
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    # Products of longs as decimals of 38 digits; integer division of those is exact.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    up = F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")).cast("decimal(34,0)")
    cuts = cuts.withColumn("up", up).withColumn("down", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("cast(up div down as long)"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = first_n_per_group(best, ["lang"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP,
    shards: int = SHARDS, size: int = CHUNK, most: int = MOST,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` collocations of each language.

    A null lang is `und`, a null text empty; rows that repeat count each. A table without words
    gives no rows. Up to `most` frequent words and candidates are sent to all tasks; where there
    are more candidates, phrases are counted level by level in shuffles, and where there are more
    words, every phrase is counted in one shuffle, with the same result.
    """
    docs = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))
    every = materialised(all_phrases(docs, 1, size), "words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.filter(F.col("f") >= support)
    counts = son_counts(docs, words, support, longest, shards, size, most)
    if counts is None:
        counts = all_phrases(docs, longest, size).filter(F.col("f") >= support)
    return ranked(materialised(counts, "phrases"), totals, support, top)


def op13_collocations(spark, folder):
    """All documents."""
    return collocations(documents(spark, folder))


_SPLIT = r"[.,;:!?\x0A-\x0D]"
OP13_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_SPLIT}')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
  FROM w, unnest(range(1, {LONGEST + 1})) AS a(k), unnest(range(1, len(ws) - k + 2)) AS b(i)
  GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
x AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, t.n,
         (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM c, unnest(range(1, c.k)) AS u(cut), t, g AS l, g AS r
  WHERE t.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.ws[1:cut], ' ') AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM c, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(i) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank,
       b.phrase, a, l, r, n, score::BIGINT AS score
FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE around IS NULL OR around < a
QUALIFY rank <= {TOP}
"""

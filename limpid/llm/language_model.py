"""Operator 8: texts scored by a weighted backoff automaton of corpus n-grams.

States are n-grams that can be extended, and the root. An arc reads a word at the log
probability of its discounted n-gram; a state without an arc for the next word fails to its
longest shorter state at the log of its backoff weight. The root reads any word at its
smoothed unigram probability, so the probabilities of each state add up to one.

Every n-gram that occurs `LEAST` times is an arc, however large the corpus. A text's score adds up
over its n-grams: an arc adds what it gains over failing, and a context its backoff weight, since
each word of a text is followed by another or by the end. So the arcs are a distributed table that
the n-grams of each text are joined to; `Automaton` is the same model in memory. Only what makes
up `COMMON` or `SHARE[n]` of all tokens, at most 1 / SHARE[n] n-grams, is broadcast and looked up
in place. Before n-grams are shuffled, a bitmap of fixed size drops those that cannot be in
the table, or have a part that cannot. Both change the cost and never the score.

What is shuffled is packed: sorted keys as compressed differences, dealt by their leading bits into
buckets of about `BUCKET` tokens. A chunk of texts asks each bucket once for every different
key that it has there, keeps which text has which, and adds up the values that come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import documents, held_out
from limpid.storage import discard, materialised_alone as materialised

ORDER = 3
#: Share of the training tokens from which on a word, or an n-gram of order 2, 3, ..., is broadcast.
COMMON = 1e-6
SHARE = {2: 2e-6, 3: 2e-6}
LEAST = 3  # occurrences of an n-gram that is an arc
FILTER = 21  # log2 of the 64-bit words of a bitmap
HELD = 1 << 20  # n-grams that a task adds up before it hands them on
CHUNK = 1 << 21  # words and n-grams of a chunk of texts, which are looked up together
SLICE = 1 << 18  # of which so many are added up at once
SCALE = 2.0**32  # values that come back are whole numbers of its inverse, so each is right to 1.2e-10
BUCKET = 1 << 20  # tokens of the corpus for each bucket that keys are dealt into
DISCOUNT = 0.5
ADDED = 0.1
END = np.uint64(1)  # hash of the end token, which no word has: see `_tokens`


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the lower-cased words, with an end after each text."""
    data = tb.lowered(data)
    starts, ends, first = tb.words(data, offsets)
    h = tb.span_hashes(tb.prefix_sums(data), starts, ends) | np.uint64(2)
    n = len(offsets) - 1
    out = np.empty(len(h) + n, np.uint64)
    at_end = first[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[at_end] = False
    out[is_word], out[at_end] = h, END
    return out, np.r_[0, at_end + 1]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the key of its first words and its last word."""
    return tb.mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _tally(batches, keys_of) -> Iterator[pa.RecordBatch]:
    tally = tb.Tally()
    for batch in batches:
        data, offsets = tb.texts(batch.column("text"))
        for low, high in tb.pieces(offsets):
            part = offsets[low : high + 1]
            tokens, first = _tokens(data[part[0] : part[-1]], part - part[0])
            for keys, counts in keys_of(tokens, first):
                tally.add(keys, counts)
            if tally.full():
                yield tally.batch()
    if (last := tally.batch()) is not None:
        yield last


def count_words(training: DataFrame) -> DataFrame:
    """h, n of every distinct token; counts are added up in each task before the shuffle."""

    def run(batches):
        return _tally(batches, lambda tokens, first: [tb.counted(tokens)])

    return training.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _levels(tokens: np.ndarray, first: np.ndarray, order: int) -> Iterator[tuple]:
    """(n, place of the last word, key of all words but the last, key of all but the first) of the
    n-grams of each order, within texts; `_joined` of the two keys is that of the n-gram."""
    keys, inside = tokens, np.ones(len(tokens), bool)
    for n in range(2, order + 1):
        at = first[:-1] + n - 2
        inside[at[at < first[1:]]] = False
        last = np.flatnonzero(inside)
        context, rest = keys[last - 1], keys[last]
        yield n, last, context, rest
        keys = np.zeros(len(tokens), np.uint64)
        keys[last] = _joined(context, rest)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit is set for each h; a key whose bit is not set is not there."""
    slot = F.shiftrightunsigned("h", 64 - FILTER).alias("slot")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 8) & 63 as int))").alias("bit")
    rows = keys.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^FILTER rows at most
    out = np.zeros(1 << FILTER, np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot, bit = h >> np.uint64(64 - FILTER), (h >> np.uint64(8)) & np.uint64(63)
    return (bits[slot] >> bit) & np.uint64(1) == 1


def _bits(tokens: int) -> int:
    """Leading bits of a key that tell its bucket."""
    return max(1, (tokens // BUCKET).bit_length())


def _cuts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, low, high) of the buckets that sorted keys fall into."""
    bucket = keys >> np.uint64(64 - bits)
    low = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    yield from zip(bucket[low].tolist(), low.tolist(), np.r_[low[1:], len(keys)].tolist())


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as a compressed value. Bytes of like weight stand together, as they resemble each other."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(value, *kinds) -> list[np.ndarray]:
    raw, sizes = value.as_buffer(), [np.dtype(k).itemsize for k in kinds]
    n = int.from_bytes(raw[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(raw[8:], n * sum(sizes), "zstd"), np.uint8)
    ends = np.cumsum([n * size for size in sizes])
    parts = [planes[end - n * size : end].reshape(size, n) for size, end in zip(sizes, ends.tolist())]
    return [np.ascontiguousarray(part.T).view(k).reshape(n) for part, k in zip(parts, kinds)]


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of ordered unsigned values, the first from 0; `np.cumsum` undoes it."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def _keys(value) -> np.ndarray:
    return np.cumsum(_unpacked(value, np.uint64)[0], dtype=np.uint64)


def _parts(words: list[np.ndarray]) -> list[np.ndarray]:
    """The keys of all words but the last and of all but the first, of n-grams given by their words."""
    while len(words) > 2:
        words = [_joined(a, b) for a, b in zip(words, words[1:])]
    return words


def count_grams(training: DataFrame, size: int, parts_kept: np.ndarray, common: np.ndarray, bits: int) -> DataFrame:
    """h, context, rest, n of the n-grams of `size` words that occur `LEAST` times.

    A task's n-grams go out as words: a place in `common`, or beyond it among the other words of the row.
    """
    shared = training.sparkSession.sparkContext.broadcast((parts_kept, common))
    schema = "bucket int, others binary, grams binary"

    def merged(held):
        h, n, *words = (np.concatenate(x) for x in zip(*held))
        at = np.argsort(h)
        new = np.flatnonzero(np.r_[True, np.diff(h[at]) != 0]) if len(h) else at
        return h[at][new], np.add.reduceat(n[at], new) if len(h) else n, *(w[at[new]] for w in words)

    def batch_of(held, often):
        h, n, *words = merged(held)
        places = [often.find(w) for w in words]
        rows = []
        for bucket, low, high in _cuts(h, bits):
            codes, rare = [at[low:high].astype(np.uint32) for at in places], [at[low:high] < 0 for at in places]
            others, at = np.unique(np.concatenate([w[low:high][r] for w, r in zip(words, rare)]), return_inverse=True)
            at = np.split(at + len(shared.value[1]), np.cumsum([r.sum() for r in rare])[:-1])
            for code, r, x in zip(codes, rare, at):
                code[r] = x
            order = np.lexsort(codes[::-1])
            columns = [_steps(codes[0][order]), *(code[order] for code in codes[1:]), n[low:high][order].astype(np.uint32)]
            rows.append((bucket, _packed(_steps(others)), _packed(*columns)))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def run(batches):
        kept, often, held = shared.value[0], tb.Places(shared.value[1]), []
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            for low, high in tb.pieces(offsets):
                part = offsets[low : high + 1]
                tokens, first = _tokens(data[part[0] : part[-1]], part - part[0])
                *_, (_, last, context, rest) = _levels(tokens, first, size)
                some = _maybe(kept, context) & _maybe(kept, rest)
                h, last = _joined(context[some], rest[some]), last[some]
                words = [tokens[last - back] for back in range(size - 1, -1, -1)]
                held.append(merged([(h, np.ones(len(h), np.int64), *words)]))
                if sum(len(x[0]) for x in held) > HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield batch_of(held, often)
                        held = []
        if held:
            yield batch_of(held, often)

    def added(rows):
        held = []
        for others, grams in zip(rows.column("others"), rows.column("grams")):
            *codes, n = _unpacked(grams, *[np.uint32] * (size + 1))
            codes[0] = np.cumsum(codes[0], dtype=np.uint32)
            known = np.r_[shared.value[1], _keys(others)]
            words = [known[code] for code in codes]
            held.append((_joined(*_parts(words)), n.astype(np.int64), *words))
        h, n, *words = merged(held)
        some = n >= LEAST
        context, rest = _parts([w[some] for w in words])
        columns = [*(x.view(np.int64) for x in (h[some], context, rest)), n[some]]
        return pa.Table.from_arrays([pa.array(x) for x in columns], ["h", "context", "rest", "n"])

    return training.select("text").mapInArrow(run, schema).groupBy("bucket").applyInArrow(added, "h long, context long, rest long, n long")


@dataclass
class Automaton:
    """Root is state 0. Arcs are sorted by state * 2^32 + word."""

    words: np.ndarray  # hashes of common words, sorted
    base: np.ndarray  # their log10 unigram probabilities
    arcs: np.ndarray
    arc_score: np.ndarray
    arc_to: np.ndarray
    fail: np.ndarray
    backoff: np.ndarray
    root_to: np.ndarray  # the state that a common word leads to from the root

    def traverse(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text, without the unigram part of words that are not common.

        One step reads the next word of every text that still has one; each text carries its
        state. ids: place in `words`, -1 for a word that is not common.
        """
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = first[:-1][order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        alive = len(order)
        for step in range(int(lengths[0]) if alive else 0):
            alive = int(np.searchsorted(-lengths[:alive], -step, "left"))
            word = ids[starts[:alive] + step]
            todo = np.arange(alive)
            while len(todo):
                at, w = state[todo], word[todo]
                root = at == 0
                done = todo[root]
                known = w[root] >= 0
                total[done[known]] += self.base[w[root][known]]
                state[done] = np.where(known, self.root_to[w[root]], 0)
                todo, at, w = todo[~root], at[~root], w[~root]
                arc = tb.find(self.arcs, (at << 32) + w)
                hit = (arc >= 0) & (w >= 0)
                total[todo[hit]] += self.arc_score[arc[hit]]
                state[todo[hit]] = self.arc_to[arc[hit]]
                miss = todo[~hit]
                total[miss] += self.backoff[at[~hit]]
                state[miss] = self.fail[at[~hit]]
                todo = miss
        out = np.zeros(len(order))
        out[order] = total
        return out


def build(words: np.ndarray, counts: np.ndarray, total: int, vocabulary: int, grams: list[dict]) -> Automaton:
    """grams[n - 2]: {tuple of places in words: count} of the kept n-grams of order n."""
    p1 = (counts + ADDED) / (total + ADDED * (vocabulary + 1))
    seen = [{(i,): c for i, c in enumerate(counts.tolist())}, *grams]
    states: dict[tuple, int] = {(): 0}
    for level in grams:
        for gram in level:
            states.setdefault(gram[:-1], len(states))

    def longest(gram: tuple) -> int:
        while gram not in states:
            gram = gram[1:]
        return states[gram]

    prob: dict[tuple, float] = {}
    backoff = np.zeros(len(states))
    spent: dict[tuple, list[float]] = {}

    def p(gram: tuple) -> float:
        """Probability of the last word after the others, through the failure arcs."""
        if len(gram) == 1:
            return float(p1[gram[0]])
        if gram in prob:
            return prob[gram]
        weight = 10 ** backoff[states[gram[:-1]]] if gram[:-1] in states else 1.0
        return weight * p(gram[1:])

    for level in grams:  # a state's backoff weight needs the level below only
        for gram, c in level.items():
            prob[gram] = (c - DISCOUNT) / seen[len(gram) - 2][gram[:-1]]
            mass = spent.setdefault(gram[:-1], [0.0, 0.0])
            mass[0] += prob[gram]
            mass[1] += p(gram[1:])
        for context, (own, lower) in spent.items():
            if len(context) == len(next(iter(level), ())) - 1:
                backoff[states[context]] = np.log10(max(1 - own, 1e-12) / max(1 - lower, 1e-12))
    fail = np.zeros(len(states), np.int64)
    for gram, i in states.items():
        fail[i] = longest(gram[1:]) if gram else 0
    rows = sorted(
        ((states[g[:-1]] << 32) + g[-1], np.log10(x), longest(g if len(g) <= len(grams) else g[1:]))
        for g, x in prob.items()
    )
    arcs, score, to = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    root_to = np.array([states.get((i,), 0) for i in range(len(words))] or [0], np.int64)
    return Automaton(words, np.log10(p1), arcs.astype(np.int64), score, to.astype(np.int64), fail, backoff, root_to)


@dataclass
class Model:
    words: DataFrame  # h, n, p, backoff of every training token
    arcs: DataFrame  # h, n, value of every n-gram: what it adds to the score of a text
    bits: int  # leading bits of a key that tell its bucket
    common: tuple[np.ndarray, ...]  # hashes, log10 probabilities and backoff weights of common words
    frequent: tuple[np.ndarray, np.ndarray]  # hashes and values of frequent n-grams
    known: np.ndarray  # bitmap of all arcs
    total: int
    vocabulary: int


def _sorted(rows, *names: str) -> tuple[np.ndarray, ...]:
    h = rows["h"].to_numpy().view(np.uint64)
    at = np.argsort(h)
    return h[at], *(rows[c].to_numpy()[at] for c in names)


def fit(training: DataFrame, order: int = ORDER) -> Model:
    """Counts of all training tokens and n-grams, and what each adds to a score."""
    counts = materialised(count_words(training), "words")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    whole = total + ADDED * (vocabulary + 1)
    words = lower = counts.select("h", "n", ((F.col("n") + ADDED) / F.lit(whole)).alias("p"))
    added, bits, done = [], _bits(total), [counts]
    often = F.col("n") >= max(2, COMMON * total)  # 1 / COMMON rows at most
    (common,) = _sorted(counts.filter(often).select("h").toArrow())
    for size in range(2, order + 1):
        # A part of an n-gram occurs at least as often, so it has a row here.
        lower = lower.filter(F.col("n") >= LEAST)
        grams = materialised(count_grams(training, size, bitmap(lower), common, bits), f"grams-{size}")
        of_context = lower.select(F.col("h").alias("context"), F.col("n").alias("_n"))
        of_rest = lower.select(F.col("h").alias("rest"), F.col("p").alias("below"))
        level = grams.join(of_context, "context").join(of_rest, "rest")
        level = level.select("h", "context", "n", ((F.col("n") - DISCOUNT) / F.col("_n")).alias("p"), "below")
        level = materialised(level, f"level-{size}")
        discard(grams)
        left = lambda c: F.greatest(1 - F.sum(c), F.lit(1e-12))
        backoff = level.groupBy("context").agg(F.log10(left("p") / left("below")).alias("backoff"))
        backoff = materialised(backoff, f"backoff-{size}")
        done += [level, backoff]
        gain = F.log10("p") - F.log10("below") - F.col("backoff")
        added.append(level.join(backoff, "context").select("h", "n", gain.alias("value")))
        of_h = backoff.select(F.col("context").alias("h"), "backoff")
        if size == 2:
            words = materialised(words.join(of_h, "h", "left").fillna(0.0, ["backoff"]), "weighted-words")
        else:
            added.append(of_h.select("h", F.lit(0).cast("long").alias("n"), F.col("backoff").alias("value")))
        lower = level.select("h", "n", "p")
    every = added[0]
    for more in added[1:]:
        every = every.unionByName(more)
    arcs = materialised(every.groupBy("h").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "arcs")
    discard(*done)
    common = words.filter(often).select("h", F.log10("p").alias("base"), "backoff").toArrow()
    frequent = arcs.filter(F.col("n") >= max(LEAST, min(SHARE.values()) * total)).select("h", "value").toArrow()  # 1 / SHARE rows of an order
    return Model(words, arcs, bits, _sorted(common, "base", "backoff"), _sorted(frequent, "value"), bitmap(arcs), total, vocabulary)


_OWN, _ARCS, _WORDS = 0, 1, 2  # of a row: a chunk's texts, n-grams, words
_MODEL = -1  # as a chunk: the rows of the model
_ROWS = "bucket int, chunk long, kind int, data binary, ids array<long>, held array<boolean>, arcs binary, words binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
    columns = zip(*((*row, *[None] * (len(kinds) - len(row))) for row in rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _ROWS.split(", ")])


def _asked(kind: int, chunk: int, parts: list[tuple], bits: int) -> tuple[bytes, list[tuple]]:
    """(texts, places of their keys among the chunk's different ones, and how often; a row for each bucket)."""
    owner, h = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(h)
    h = h[order]
    new = np.r_[np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]
    pairs = np.empty(len(h), np.uint64)
    pairs[order] = np.cumsum(new) - 1
    keys = h[new]
    del order, h, new
    pairs |= owner.astype(np.uint64) << np.uint64(32)
    pairs.sort()
    first = np.flatnonzero(np.r_[np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]])
    times = np.diff(first, append=len(pairs)).astype(np.uint32)
    rows = [(bucket, chunk, kind, _packed(_steps(keys[low:high]))) for bucket, low, high in _cuts(keys, bits)]
    return _packed(_steps(pairs[first]), times), rows


def _chunks(docs: DataFrame, model: Model, order: int) -> DataFrame:
    """Each text's score over what is broadcast, by chunk, and what a chunk asks the buckets for."""
    shared = docs.sparkSession.sparkContext.broadcast((model.common, model.frequent, model.known))
    bits = model.bits

    def run(batches):
        (words, base, backoff), (frequent, value), known = shared.value
        words, frequent = tb.Places(words), tb.Places(frequent)
        base, backoff, value = (np.r_[x, 0.0] for x in (base, backoff, value))  # place -1: not there
        n_chunks, n_texts, n_held, ids, held, own, asked = 0, 0, 0, [], [], [], {_ARCS: [], _WORDS: []}

        def chunk():
            task = TaskContext.get().partitionId()
            name = (task << 32) + n_chunks
            homes, rows = {}, []
            for kind, parts in asked.items():
                homes[kind], some = _asked(kind, name, parts, bits)
                rows += some
            of_texts = _packed(*(np.concatenate(x) for x in zip(*own)))
            ids_of, held_of = (sum((x.to_pylist() for x in c), []) for c in (ids, held))
            return _row_batch([*rows, ((task + n_chunks) % (1 << bits), name, _OWN, of_texts, ids_of, held_of, homes[_ARCS], homes[_WORDS])])

        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            for low, high in tb.pieces(offsets):
                part, n = offsets[low : high + 1], high - low
                tokens, first = _tokens(data[part[0] : part[-1]], part - part[0])
                owner = np.repeat(np.arange(n), np.diff(first))
                at = words.find(tokens)
                of_words = np.bincount(owner, base[at], n)
                of_model = of_words + np.bincount(owner, backoff[at], n)
                asked[_WORDS].append(((owner[at < 0] + n_texts).astype(np.int32), tokens[at < 0]))
                for _, last, context, rest in _levels(tokens, first, order):
                    h, of = _joined(context, rest), owner[last]
                    place = frequent.find(h)
                    of_model += np.bincount(of, value[place], n)
                    other = (place < 0) & _maybe(known, h)
                    asked[_ARCS].append(((of[other] + n_texts).astype(np.int32), h[other]))
                    n_held += int(other.sum())
                ids.append(batch.column("doc_id").cast(pa.int64()).slice(low, n))
                held.append(batch.column("held_out").slice(low, n))
                own.append((np.diff(first).astype(np.int64), np.bincount(owner, at >= 0, n).astype(np.int64), of_words, of_model))
                n_texts, n_held = n_texts + n, n_held + int((at < 0).sum())
                if n_held > CHUNK:
                    yield chunk()
                    n_chunks, n_texts, n_held, ids, held, own, asked = n_chunks + 1, 0, 0, [], [], [], {_ARCS: [], _WORDS: []}
        if n_texts:
            yield chunk()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _ROWS)


def _dealt(table: DataFrame, kind: int, bits: int) -> DataFrame:
    """The keys and values of a table of the model, in rows as of a chunk."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(held):
        h, *values = (np.concatenate(x) for x in zip(*held))
        h = h.view(np.uint64)
        at = np.argsort(h)
        h, values = h[at], [np.rint(v[at] * SCALE).astype(np.int64) for v in values]
        cuts = _cuts(h, bits)
        return _row_batch([(b, _MODEL, kind, _packed(_steps(h[low:high]), *(v[low:high] for v in values))) for b, low, high in cuts])

    return table.mapInArrow(run, _ROWS)


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """A row per row of `docs` (doc_id, text, held_out): learnt where not held out, scored everywhere.

    A null or empty text is one token, the end. Without any training token all counts are 0
    and every token has the same probability.
    """
    model = fit(docs.filter(~F.col("held_out")), order)
    total = model.total
    unseen = int(np.rint(np.log10(ADDED / (total + ADDED * (model.vocabulary + 1))) * SCALE))
    of_model = {_ARCS: (np.int64,), _WORDS: (np.int64, np.int64)}

    def looked_up(rows):
        """What chunks ask a bucket for, in its place the values; a chunk's texts pass."""
        kinds, chunks = rows.column("kind").to_numpy(), rows.column("chunk").to_numpy()
        data, out = rows.column("data"), []
        for kind, types in of_model.items():
            mine = np.flatnonzero((kinds == kind) & (chunks == _MODEL))
            parts = [_unpacked(data[i], np.uint64, *types) for i in mine.tolist()]
            h, *values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.uint64, *types))
            if parts:
                h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
                at = np.argsort(h)
                h, values = h[at], [v[at] for v in values]
            default = (0,) if kind == _ARCS else (unseen, 0)
            values, table = [np.r_[v, d] for v, d in zip(values, default)], tb.Places(h)
            for i in np.flatnonzero((kinds == kind) & (chunks != _MODEL)).tolist():
                at = table.find(_keys(data[i]))
                known = [(at >= 0).astype(np.uint8)] if kind == _WORDS else []
                out.append((rows.column("bucket")[i].as_py(), int(chunks[i]), kind, _packed(*(v[at] for v in values), *known)))
        texts = rows.filter(pa.array(kinds == _OWN))
        return pa.Table.from_batches([_row_batch(out), *texts.to_batches()])

    def added(rows):
        """The scores of the texts of a chunk."""
        kinds = rows.column("kind").to_numpy()
        home = int(np.flatnonzero(kinds == _OWN)[0])
        n_tokens, n_known, base, score = _unpacked(rows.column("data")[home], np.int64, np.int64, np.float64, np.float64)
        n = len(n_tokens)
        bucket = rows.column("bucket").to_numpy()
        for kind, name in ((_ARCS, "arcs"), (_WORDS, "words")):
            types = (*of_model[kind], np.uint8) if kind == _WORDS else of_model[kind]
            mine = np.flatnonzero(kinds == kind)
            parts = [_unpacked(rows.column("data")[i], *types) for i in mine[np.argsort(bucket[mine])].tolist()]
            if not parts:
                continue
            values = [np.concatenate(x) for x in zip(*parts)]
            pairs, times = _unpacked(rows.column(name)[home], np.uint64, np.uint32)
            pairs, sums = np.cumsum(pairs, dtype=np.uint64), np.zeros((len(values), n))
            for low in range(0, len(pairs), SLICE):
                part = pairs[low : low + SLICE]
                owner, at = (part >> np.uint64(32)).astype(np.int64), (part & np.uint64(0xFFFFFFFF)).astype(np.int64)
                for total_of, v in zip(sums, values):
                    total_of += np.bincount(owner, times[low : low + SLICE] * v[at], n)
            if kind == _WORDS:
                base, score, n_known = base + sums[0] / SCALE, score + (sums[0] + sums[1]) / SCALE, n_known + sums[2].astype(np.int64)
            else:
                score = score + sums[0] / SCALE
        ids, held = (rows.column(c)[home].values for c in ("ids", "held"))
        columns = [ids, held, n_tokens, n_known, np.full(n, total, np.int64), base, score]
        return pa.Table.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _SCORED.split(", ")])

    rows = _chunks(docs, model, order)
    rows = rows.unionByName(_dealt(model.arcs.select("h", "value"), _ARCS, model.bits))
    rows = rows.unionByName(_dealt(model.words.select("h", F.log10("p").alias("p"), "backoff"), _WORDS, model.bits))
    return rows.groupBy("bucket").applyInArrow(looked_up, _ROWS).groupBy("chunk").applyInArrow(added, _SCORED)


def op8_language_model(spark, folder):
    docs = documents(spark, folder)
    return scored(docs.select("doc_id", "text", held_out("doc_id", 10, 0).alias("held_out")))

"""Operator 3: benchmark items found in documents by latent semantic retrieval.

Passages are windows of two blocks of words. Their TF-IDF vectors over the benchmark's
informative words are projected to the leading right singular vectors that a randomised SVD of
the items and of all passages finds; passages close to an item by cosine are candidates, and a
candidate stands if the longest common subsequence of words holds enough of the item and of its
answer (its last part).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import documents, rows_kept, text_of

BLOCK = 20  # words; a passage is two blocks
DIMENSIONS = 1 << 13  # hashed features
RANK, EXTRA, ITERATIONS = 128, 8, 2
ROWS = 64  # features whose products go out of a task as one array
HELD = 1 << 21  # products that a task adds up before it hands them on
COMMON = 0.05  # share of documents from which on a word is not informative
AT_LEAST = 8  # rarest words of an item that are informative anyway
EVIDENCE = 3  # informative words of an item that a passage needs; an item of fewer is not searched
COSINE = 0.45
MATCH, ANSWER, ANSWER_SHARE = 0.6, 0.5, 0.25
ITEMS = 5000  # items searched in one pass over the documents


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = tb.lowered(data)
    starts, ends, first = tb.words(data, offsets, tb.SIGNS)
    return tb.span_hashes(tb.prefix_sums(data), starts, ends), first


def _item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def _batches(batches) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = tb.texts(batch.column(batch.schema.get_field_index("text")))
        for low, high in tb.pieces(offsets):
            part = offsets[low : high + 1]
            yield batch, low, *_words(data[part[0] : part[-1]], part - part[0])


def document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold each word of the vocabulary, number of documents), over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        seen, n = np.zeros(len(known) + 1, np.int64), 0
        for _, _, h, first in _batches(batches):
            at = tb.find(known, h)
            owner = np.searchsorted(first, np.arange(len(h)), "right") - 1
            pairs = np.unique((owner[at >= 0].astype(np.int64) << 32) | at[at >= 0])
            seen[:-1] += np.bincount(pairs & 0xFFFFFFFF, minlength=len(known))
            n += len(first) - 1
        seen[-1] = n
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["i", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    counted = docs.select(text_of().alias("text")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row per word of the benchmark block
        out[r["i"]] = r["n"]
    return out[:-1], int(out[-1])


@dataclass
class Index:
    ids: list
    words: list[np.ndarray]  # of each item, in order
    vocabulary: np.ndarray  # informative words, sorted
    weight: np.ndarray  # their inverse document frequencies
    basis: np.ndarray  # [feature, dimension]
    items: np.ndarray  # unit vectors
    pairs: np.ndarray  # sorted (item << 32 | place in the vocabulary) of each item's words

    def projected(self, found: np.ndarray) -> np.ndarray:
        return self.basis[_feature(self.vocabulary[found])] * self.weight[found, None]


def _feature(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def _passages(vocabulary: np.ndarray, h: np.ndarray, first: np.ndarray):
    """(word, place, passage) of each informative word in the passages it lies in, and of each
    passage (text, first word), by passage. Passages start at blocks that hold such a word."""
    found = tb.find(vocabulary, h)
    at = np.flatnonzero(found >= 0)
    owner = np.searchsorted(first, at, "right") - 1
    sizes = -(-np.diff(first) // BLOCK) + 1  # one empty block between texts
    before = np.r_[0, np.cumsum(sizes)]
    block = before[owner] + (at - first[owner]) // BLOCK
    starts = np.unique(block)
    here = np.searchsorted(starts, block)
    ahead = tb.find(starts, block - 1)
    passage = np.r_[here, ahead[ahead >= 0]]
    word = np.r_[found[at], found[at][ahead >= 0]]
    order = np.argsort(passage, kind="stable")
    text = np.searchsorted(before, starts, "right") - 1
    return word[order], passage[order], text, first[text] + (starts - before[text]) * BLOCK


class Products:
    """Sums by pair of features (first * DIMENSIONS + second, first <= second) over many passages."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, feature: np.ndarray, weight: np.ndarray, passage: np.ndarray) -> None:
        """Rows of A are given by (passage, feature, weight), scaled to length 1; each adds its products.

        A passage has 2 * BLOCK words at most, so its products are bounded too.
        """
        start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        size = np.diff(np.r_[start, len(passage)])
        weight = weight / np.repeat(np.sqrt(np.add.reduceat(weight**2, start)), size)
        rank = np.cumsum(size**2) // HELD  # some whole passages at a time
        for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(rank)) + 1):
            each = np.repeat(size[at], size[at])
            left = np.repeat(start[at[0]] + np.arange(len(each)), each)
            right = np.repeat(np.repeat(start[at], size[at]) - np.cumsum(each) + each, each) + np.arange(len(left))
            upper = feature[left] <= feature[right]
            left, right = left[upper], right[upper]
            self._hold((feature[left] * DIMENSIONS + feature[right]).astype(np.int32), weight[left] * weight[right])

    def _hold(self, pair: np.ndarray, v: np.ndarray) -> None:
        self.held.append(tb.counted(pair, v))
        self.size += len(self.held[-1][0])
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self.held = [tb.counted(*(np.concatenate(x) for x in zip(*self.held)))]
            self.size = len(self.held[0][0])
        return self.held[0] if self.held else (np.zeros(0, np.int32), np.zeros(0))

    def batch(self, part: int) -> pa.RecordBatch:
        """What is held, in a row per `ROWS` first features; then nothing is held any more."""
        pair, v = self.merge()
        self.held, self.size = [], 0
        blocks = np.unique(pair // (ROWS * DIMENSIONS))
        cut = pa.array(np.searchsorted(pair // (ROWS * DIMENSIONS), np.append(blocks, DIMENSIONS)).astype(np.int32))
        columns = [pa.array(blocks.astype(np.int32)), pa.array(np.full(len(blocks), part, np.int32))]
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (pair, v)]
        return pa.RecordBatch.from_arrays([*columns, *lists], [c.split()[0] for c in _PRODUCTS.split(", ")])


_PRODUCTS = "block int, part int, pair array<int>, v array<double>"


def _gram(docs: DataFrame, vocabulary: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the vocabulary, A' A over them), for the TF-IDF rows A of all passages of `docs`.

    Its size does not grow with the documents. The sums of the tasks are added up in the order of the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weight))

    def run(batches):
        known, idf = shared.value
        products, part = Products(), TaskContext.get().partitionId()
        for _, _, h, first in _batches(batches):
            word, passage, *_ = _passages(known, h, first)
            if len(word):
                products.add(_feature(known[word]), idf[word], passage)
            if products.size > HELD and len(products.merge()[0]) > HELD // 2:
                yield products.batch(part)
        yield products.batch(part)

    def added(key, rows):
        total = Products()
        for i in np.argsort(rows.column("part").to_numpy(), kind="stable"):
            total._hold(*(rows.column(c)[i].values.to_numpy() for c in ("pair", "v")))
        return pa.Table.from_batches([total.batch(0)])

    sums = docs.mapInArrow(run, _PRODUCTS).groupBy("block").applyInArrow(added, _PRODUCTS)
    features = np.unique(_feature(vocabulary))
    out = np.zeros((len(features), len(features)), np.float32)
    for batch in sums.select("pair", F.col("v").cast("array<float>").alias("v")).toArrow().to_batches():
        pair, v = (batch.column(c).flatten().to_numpy() for c in ("pair", "v"))
        first, second = (np.searchsorted(features, x) for x in np.divmod(pair, DIMENSIONS))
        out[first, second] = out[second, first] = v
    return features, out


def _add_gram(out, feature, weight, passage, right) -> None:
    """out += A' (A right); rows of A are given by (passage, feature, weight), scaled to length 1."""
    start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    row = np.cumsum(np.r_[False, passage[1:] != passage[:-1]])
    weight = weight / np.sqrt(np.add.reduceat(weight**2, start))[row]
    for low in range(0, right.shape[1], 16):  # a few columns at a time
        part = right[:, low : low + 16]
        y = np.add.reduceat(part[feature] * weight[:, None], start)
        back = y[row] * weight[:, None]
        for j in range(part.shape[1]):
            out[:, low + j] += np.bincount(feature, back[:, j], len(out))


def fit(docs: DataFrame, items: list[tuple]) -> Index:
    """Corpus statistics and the SVD, both over the items and all documents."""
    words = [_item_words(text) for _, text in items]
    every = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    df, n = document_counts(docs, every)
    informative = df <= COMMON * n
    for w in words:
        at = np.searchsorted(every, np.unique(w))
        informative[at[np.argsort(df[at], kind="stable")[:AT_LEAST]]] = True
    vocabulary = every[informative]
    weight = np.log((n + 2) / (df[informative] + 1))
    rank = min(RANK + EXTRA, DIMENSIONS)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words) if words else every
    at = tb.find(vocabulary, flat)
    owner, at = owner[at >= 0], at[at >= 0]
    features, gram = _gram(docs.select(text_of().alias("text")), vocabulary, weight)
    basis = np.random.default_rng(7).standard_normal((DIMENSIONS, rank))
    for _ in range(ITERATIONS):
        image, own = np.zeros_like(basis), np.zeros_like(basis)
        image[features] = gram @ basis[features].astype(np.float32)
        if len(at):
            _add_gram(own, _feature(vocabulary[at]), weight[at], owner, basis)
        basis, _ = np.linalg.qr(image / max(1, n) + own)
    basis = basis[:, :RANK].astype(np.float32)
    pairs = np.unique((owner.astype(np.int64) << 32) | at)
    index = Index([i for i, _ in items], words, vocabulary, weight.astype(np.float32), basis, np.zeros(0), pairs)
    vectors = np.zeros((len(words), basis.shape[1]), np.float32)
    np.add.at(vectors, owner, index.projected(at))
    index.items = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return index


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of places at a time."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _verified(item: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, float]:
    """(share of the item, share of its answer) in the words around a passage.

    A common subsequence has no more words of the item than the region holds, which is
    quicker to count.
    """
    region = h[low:high]
    if np.isin(item, region).mean() < MATCH:
        return 0.0, 0.0
    tail = max(1, int(np.ceil(len(item) * ANSWER_SHARE)))
    return common_subsequence(item, region) / len(item), common_subsequence(item[-tail:], region) / tail


def _hits(index: Index, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple]:
    """{(text, item): (cosine, match, answer, first word)} of the items that stand in the texts."""
    word, passage, text, start = _passages(index.vocabulary, h, first)
    best: dict[tuple[int, int], tuple] = {}
    if not len(word):
        return best
    enough = np.bincount(passage, minlength=len(text)) >= EVIDENCE
    keep = enough[passage]
    word, passage = word[keep], passage[keep]
    for low in range(0, len(word), 1 << 16):
        # Passages that begin in this part of the words; each is taken with all its words.
        if low and passage[low] == passage[low - 1]:
            low = int(np.searchsorted(passage, passage[low], "right"))
        high = low + (1 << 16)
        high = int(np.searchsorted(passage, passage[high], "right")) if high < len(word) else len(word)
        if low >= high:
            continue
        row = np.flatnonzero(np.r_[True, passage[low + 1 : high] != passage[low : high - 1]])
        vectors = np.add.reduceat(index.projected(word[low:high]), row)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        cosine = vectors @ index.items.T
        close, items = np.nonzero(cosine >= COSINE)
        # Of the candidates, those whose passage holds enough informative words of the item.
        sizes = np.diff(np.r_[row, high - low])[close]
        candidate = np.repeat(np.arange(len(close)), sizes)
        inside = np.arange(len(candidate)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of_item = (items[candidate].astype(np.int64) << 32) | word[low + row[close][candidate] + inside]
        shared = np.bincount(candidate, tb.find(index.pairs, of_item) >= 0, len(close)) >= EVIDENCE
        for r, j in zip(close[shared], items[shared]):
            p = int(passage[low + row[r]])
            item, t = index.words[j], int(text[p])
            key = (t, int(j))
            if len(item) == 0 or (key in best and best[key][1] >= 0.999):
                continue
            begin = max(int(first[t]), int(start[p]) - len(item))
            stop = min(int(first[t + 1]), int(start[p]) + 2 * BLOCK + len(item))
            match, answer = _verified(item, h, begin, stop)
            if match >= MATCH and answer >= ANSWER and (key not in best or match > best[key][1]):
                best[key] = (float(cosine[r, j]), match, answer, int(start[p] - first[t]))
    return best


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """One index per `ITEMS` items, so what is broadcast does not grow with the benchmark."""
    rows = ((r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator())
    while block := list(islice(rows, ITEMS)):
        yield fit(docs, block)


_FOUND = "doc_id long, item_id long, cosine double, match double, answer double, first_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item that stands in it, by its best passage.

    Documents without a hit have no row; neither do null or empty texts, nor items of fewer than
    `EVIDENCE` informative words. A row of `docs` that occurs twice gives its hits twice, an item with two ids both.
    """
    d = docs.select("doc_id", text_of().alias("text"))
    found = None
    for index in _indexes(d, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            known = shared.value
            for batch, low, h, first in _batches(batches):
                hits = sorted(_hits(known, h, first).items())
                ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([low + t for (t, _), _ in hits], pa.int64()))
                out = [[known.ids[j] for (_, j), _ in hits], *(list(x) for x in zip(*(v for _, v in hits)))]
                out += [[] for _ in range(5 - len(out))]
                types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                columns = [pa.array(v, t) for v, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays([ids, *columns], [c.split()[0] for c in _FOUND.split(", ")])

        part = d.mapInArrow(run, _FOUND)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], _FOUND) if found is None else found


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no item stands."""
    for index in _indexes(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            known = shared.value
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                for _, low, h, first in _batches([batch]):
                    hit[[low + t for t, _ in _hits(known, h, first)]] = True
                yield batch.filter(pa.array(~hit))

        docs = rows_kept(docs, run)
    return docs


def op3_decontaminate(spark, folder):
    return contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))

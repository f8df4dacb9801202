"""Operator 5: languages by rank-order profiles of frequent letter n-grams.

A profile is the list of the `KEPT` most frequent n-grams of one to three letters, a blank
standing at both ends of a word. A document's own list is compared with each language's: each
n-gram costs the difference of its two ranks, or `KEPT` where the language does not have it.
The least sum is the language.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from limpid.llm import textbytes as tb
from limpid.llm.columns import documents, held_out
from limpid.operators.sampling import first_n_per_group

KEPT = 300
PIECE = 1 << 20
UNKNOWN = "und"
_BLANK = 0x20
_OWNER = np.uint64(44)  # bits of an n-gram's hash; the rest number the texts of a piece


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> np.ndarray:
    """Sorted (text << 44 | hash) of all n-grams of the texts."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in lowered])
    letter = _letters()[codes]
    # A blank stays where a letter follows, and at the end of its text.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[np.cumsum([len(t) for t in lowered]) - 1] = True
    codes, owner, letter = np.where(letter, codes, _BLANK)[keep].astype(np.uint64), owner[keep], letter[keep]
    found = [(owner[letter] << _OWNER) | _short(codes[letter])]
    if len(codes) > 1:
        ok = (owner[1:] == owner[:-1]) & (letter[1:] | letter[:-1])
        two = (codes[:-1] << np.uint64(21)) | codes[1:]
        found.append((owner[1:][ok] << _OWNER) | _short(two[ok]))
    if len(codes) > 2:
        ok = (owner[2:] == owner[:-2]) & letter[1:-1]
        three = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
        found.append((owner[2:][ok] << _OWNER) | _short(three[ok]))
    return np.sort(np.concatenate(found))


def _short(codes: np.ndarray) -> np.ndarray:
    return tb.mixed(codes) >> (np.uint64(64) - _OWNER)


def _pieces(texts: list[str]):
    low, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield low, i
            low, size = i, 0
        size += len(t) + 2
    if low < len(texts):
        yield low, len(texts)


def profiles(training: DataFrame, kept: int = KEPT) -> DataFrame:
    """lang, h, place: each language's most frequent n-grams; ties by hash.

    `training` has text and lang. Counts are added up in each task, so a language with most of
    the rows sends as little as any other.
    """

    def run(batches):
        tallies: dict[str, tb.Tally] = {}

        def out(lang):
            rows = tallies[lang].batch()
            return pa.RecordBatch.from_arrays([pa.array([lang] * rows.num_rows), *rows.columns], ["lang", "h", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in _pieces(texts):
                key = grams(texts[low:high])
                owner, h = (key >> _OWNER).astype(np.int64), key & np.uint64((1 << 44) - 1)
                for lang in set(langs[low:high]):
                    mine = (langs[low:high] == lang)[owner]
                    if mine.any():
                        tallies.setdefault(lang, tb.Tally()).add(*tb.counted(h[mine]))
                        if tallies[lang].full():
                            yield out(lang)
        for lang, tally in tallies.items():
            if tally.held:
                yield out(lang)

    sums = training.select("text", "lang").mapInArrow(run, "lang string, h long, n long")
    sums = sums.groupBy("lang", "h").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("h")]
    # Cut in each task, then in slices of tasks: no task sorts all n-grams of a language.
    top = first_n_per_group(sums, ["lang"], order, kept)
    place = F.row_number().over(W.partitionBy("lang").orderBy(*order)) - 1
    return top.select("lang", "h", place.alias("place"))


@dataclass
class Profiles:
    languages: list[str]
    keys: np.ndarray  # n-grams of any language, sorted
    places: np.ndarray  # [n-gram, language], KEPT where it has none


def collected(found: DataFrame, kept: int = KEPT) -> Profiles:
    """On the driver: `kept` rows for each language, of which there are some thousands at most."""
    rows = found.toPandas()
    languages = sorted(rows["lang"].unique())
    keys = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64))
    places = np.full((len(keys), len(languages)), kept, np.int32)
    at = np.searchsorted(keys, rows["h"].to_numpy(np.int64).view(np.uint64))
    places[at, np.searchsorted(languages, rows["lang"])] = rows["place"]
    return Profiles(languages, keys, places)


def distances(texts: list[str], known: Profiles, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """([text, language] sums of out-of-place distances, number of n-grams compared)."""
    key, count = np.unique(grams(texts), return_counts=True)
    owner = (key >> _OWNER).astype(np.int64)
    # The keys are in order of text and hash, so a stable sort leaves ties by hash.
    order = np.argsort((owner << 32) + (int(count.max()) if len(count) else 0) - count, kind="stable")
    owner, key = owner[order], key[order]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    place = np.arange(len(owner)) - first[owner]
    top = place < kept
    owner, key, place = owner[top], key[top] & np.uint64((1 << 44) - 1), place[top]
    at = tb.find(known.keys, key)
    out = np.zeros((len(texts), len(known.languages)))
    for j in range(len(known.languages)):
        there = np.where(at >= 0, known.places[at, j], kept)
        cost = np.where(there < kept, np.abs(there - place), kept)
        out[:, j] = np.bincount(owner, cost, len(texts))
    return out, np.bincount(owner, minlength=len(texts))


def predicted(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang, held_out).

    Learns from rows not held out whose lang is not null. A text that is null or has no letter
    is `und` with score 0, and so is every text if there is nothing to learn from. Languages
    at equal distance: the first by name. The score is 1 minus the distance as a share of
    the largest possible one.
    """
    known = collected(profiles(docs.filter("not held_out and lang is not null"), kept), kept)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches):
        learnt = shared.value
        names = np.array([*learnt.languages, UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for low, high in _pieces(texts):
                if not learnt.languages:
                    break
                cost, n = distances(texts[low:high], learnt, kept)
                some = n > 0
                best[low:high][some] = cost.argmin(1)[some]
                score[low:high] = np.where(some, 1 - cost.min(1) / (kept * np.maximum(n, 1)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("held_out"),
                    pa.array(names[best], pa.string()), pa.array(score),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def op5_language_id(spark, folder):
    docs = documents(spark, folder)
    return predicted(docs.select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out")))

"""Profiles and predictions of languages against plain counting and plain distances."""

import collections
import random

from pyspark.sql import functions as F

from limpid.llm import language_id


def texts(rng, letters, n):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def plain_ranks(counts, kept):
    order = sorted(counts, key=lambda h: (-counts[h], h))[:kept]
    return {h: i for i, h in enumerate(order)}


def grams_of(text):
    return collections.Counter(int(g) & ((1 << 44) - 1) for g in language_id.grams([text]))


def test_predictions_equal_plain_distances(spark, awkward):
    rng = random.Random(4)
    kept = 40
    rows = [(lang, t) for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "éüxyz")) for t in texts(rng, letters, 30)]
    rows += [("aa", None), ("bb", ""), (None, "abc abd"), ("cc", "12 34")] + [(None, t) for _, t in awkward]
    docs = [(i, t, lang, i % 4 == 0) for i, (lang, t) in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, held_out boolean").repartition(5)
    sums = collections.defaultdict(collections.Counter)
    for _, t, lang, out in docs:
        if lang is not None and not out:
            sums[lang] += grams_of(t or "")
    known = {lang: plain_ranks(c, kept) for lang, c in sums.items()}
    found = collections.defaultdict(dict)
    for r in language_id.profiles(df.filter("not held_out and lang is not null"), kept).collect():
        found[r["lang"]][r["h"]] = r["place"]
    assert found == known
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(df, kept).collect()}
    for i, t, _, _ in docs:
        mine = plain_ranks(grams_of(t or ""), kept)
        if not mine:
            assert got[i] == ("und", 0.0)
            continue
        cost = {
            lang: sum(abs(ranks[h] - p) if h in ranks else kept for h, p in mine.items()) for lang, ranks in known.items()
        }
        best = min(sorted(cost), key=lambda lang: cost[lang])
        assert got[i][0] == best and abs(got[i][1] - (1 - cost[best] / (kept * len(mine)))) < 1e-12


def test_no_task_sorts_a_whole_language(spark, make):
    docs = make([(i, "some text") for i in range(4)]).withColumn("lang", F.lit("en"))
    plan = language_id.profiles(docs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan

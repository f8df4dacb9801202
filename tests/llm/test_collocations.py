"""Collocations against counting by hand, whatever the shards and the way of counting."""

import collections
import random
import re

import pytest

from limpid.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, longest=5, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    wanted = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= support}
    out = collections.defaultdict(list)
    for (lang, phrase), a in wanted.items():
        inside = lambda q: any(q[i : i + len(phrase)] == phrase for i in range(len(q) - len(phrase) + 1))
        if any(g == lang and len(q) > len(phrase) and inside(q) and 100 * c >= 100 * a for (g, q), c in wanted.items()):
            continue
        cuts = [(f[lang, phrase[:k]], f[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def corpus(rng, n):
    """Short texts of few words with set phrases, copies, both languages and a rare one."""
    words = ["red", "Big", "house", "of", "the", "ünd", "x", "on"]
    fixed = ["New York City", "in spite of", "the the the", "a b c d e f", "ice-cream"]
    rows = []
    for i in range(n):
        parts = [rng.choice(words + fixed) for _ in range(rng.randint(0, 25))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None]), text))
    return rows + rows[:10] + [("yy", "one two " * 40), ("zz", ""), (None, None), ("und", "red big " * 9)]


def table(spark, rows):
    schema = "doc_id long, lang string, text string, phrase string, k int, n long, f long, `n.n` string, score double"
    return spark.createDataFrame([(i, lang, t, "p", 1, 2, 3, "x", 0.5) for i, (lang, t) in enumerate(rows)], schema)


def got(docs, **options):
    return sorted(tuple(r) for r in co.collocations(docs, **options).collect())


@pytest.mark.parametrize(
    "shards, size, most, parts", [(8, co.CHUNK, co.MOST, 1), (3, 300, co.MOST, 5), (8, 2000, 0, 3), (2, 900, 40, 4)]
)
def test_equals_counting_by_hand(spark, monkeypatch, shards, size, most, parts):
    """One task and many, small chunks, and more words or candidates than may be sent around."""
    monkeypatch.setattr(co, "BLOCK", 5)
    rows = corpus(random.Random(7), 260)
    docs = table(spark, rows).repartition(parts)
    assert got(docs, support=20, shards=shards, size=size, most=most) == brute(rows, 20)


def test_more_candidates_than_may_be_sent(spark, monkeypatch):
    """Phrases are then counted by their numbers, level by level; never as texts of every phrase."""
    rows = corpus(random.Random(9), 150)
    spelt, all_phrases = [], co.all_phrases
    monkeypatch.setattr(co, "all_phrases", lambda docs, longest, *more: spelt.append(longest) or all_phrases(docs, longest, *more))
    assert got(table(spark, rows).repartition(3), support=10, most=80) == brute(rows, 10)
    assert spelt == [1]


def test_phrases_of_one_hash_stay_apart():
    h = co.np.array([5, 5, 1, 5, 5], co.np.uint64)
    columns = [co.np.array(c, co.np.int32) for c in ([7, 8, 9, 7, 8], [1, 1, 1, 1, 2])]
    got = co._summed(h, columns, co.np.array([1, 2, 3, 4, 5]))
    assert sorted(zip(got[0].tolist(), *(c.tolist() for c in got[1]), got[2].tolist())) == [(1, 9, 1, 3), (5, 7, 1, 5), (5, 8, 1, 2), (5, 8, 2, 5)]


def test_ties_are_broken_by_bytes_and_the_list_ends(spark):
    rows = [("en", ". ".join(f"{a} {b}" for a in "zaéB" for b in ("k", "É", "m")))] * 6
    assert got(table(spark, rows), support=6, top=5) == brute(rows, 6, top=5)


def test_awkward(spark, awkward):
    rows = [("xx", t) for _, t in awkward] * 3
    assert got(table(spark, rows), support=40) == brute(rows, 40)


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", " .,\n")], [("en", "a b")]])
def test_nothing_frequent(spark, rows):
    assert got(table(spark, rows)) == []


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", "a b", 2, 3 * 10**12), ("en", "a", 1, 4 * 10**12 + 1), ("en", "b", 1, 3 * 10**12 + 7)],
        "lang string, phrase string, k int, f long",
    )
    totals = spark.createDataFrame([("en", 10**14 + 3)], "lang string, n long")
    a, l, r, n = 3 * 10**12, 4 * 10**12 + 1, 3 * 10**12 + 7, 10**14 + 3
    assert [tuple(x) for x in co.ranked(counts, totals, 100, 10).collect()] == [
        ("en", 1, "a b", a, l, r, n, 1000 * a * n // (l * r))
    ]


def test_a_shard_is_mined_completely(spark):
    """Per shard, exactly the phrases that reach its share of the support."""
    rng = random.Random(3)
    rows = [("x", " ".join(rng.choice(["a", "b", "c. ", "d"]) for _ in range(rng.randint(0, 30)))) for _ in range(120)]
    docs = table(spark, rows).repartition(6).select("lang", "text")
    words = co.Vocabulary({"x": ["a", "b", "c", "d"]})
    encoded = co.encoded(docs, words, 3)
    supports = co.local_supports(encoded, 30)
    assert set(supports) == {0, 1, 2} and sum(supports.values()) in (30, 31, 32)
    counts = collections.defaultdict(collections.Counter)
    for r in encoded.collect():
        ids = memoryview(r["words"]).cast("i").tolist()
        for k in (2, 3):
            for i in range(len(ids) - k + 1):
                if min(ids[i : i + k]) >= 0:
                    counts[r["shard"], k][tuple(ids[i : i + k])] += 1
    trie = co.Trie()
    for k in (2, 3):
        found = co.frequent_in_shards(encoded, trie, k, supports).collect()
        want = {(s, n) for (s, length), c in counts.items() if length == k for n in c.values() if n >= supports[s]}
        assert {(r["shard"], r["n"]) for r in found} == want
        assert len(found) == sum(n >= supports[s] for (s, length), c in counts.items() if length == k for n in c.values())
        pairs = sorted({(r["lang"], r["key"]) for r in found})
        trie.extend(co.pa.table({"lang": [p[0] for p in pairs], "key": [p[1] for p in pairs]}), k)
    names = {trie.phrase("x", 2, i, words.words["x"]) for i in range(len(trie.levels["x"][0]))}
    assert names == {" ".join("abcd"[i] for i in p) for (s, k), c in counts.items() if k == 2 for p, n in c.items() if n >= supports[s]}

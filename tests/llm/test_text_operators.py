"""Each operator against brute force on small tables, awkward rows and empty tables."""

import collections
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from limpid.llm import (
    decontaminate, language_id, language_model, license_scan, line_quality, mixing, near_copies,
    quality_rules, repeats, sanitise, textbytes, wide_copies,
)
from limpid.llm.columns import held_out

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rest(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus if doc is not None else None


# --- 1: repeats ---------------------------------------------------------------------------


def brute_repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def digest(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_repeats_awkward(make, awkward, hot):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:3000]) for i, t in awkward]
    got = digest(repeats.without_repeats(make(rows), with_text=False, hot=hot))
    assert got == brute_repeats(rows, repeats.LENGTH)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_short_lengths(make, sentence, seed):
    rng = random.Random(seed)
    shared = [sentence(rng, 25) for _ in range(3)]
    rows = []
    for i in range(25):
        parts = [sentence(rng, rng.randint(0, 15)) for _ in range(4)] + rng.choices(shared, k=2)
        rng.shuffle(parts)
        rows.append((i, rng.choice(["", "\n"]).join(parts)))
    rows += [(90, "ab" * 200), (91, "ab" * 30), (92, "q" * 300)]
    got = digest(repeats.without_repeats(make(rows), length=60, k=20, with_text=False))
    assert got == brute_repeats(rows, 60)


def test_index_is_exact_for_any_texts():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(rng.randint(1, 6))]
        seen = collections.Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4))
        for t, marked in zip(texts, repeats.repeated_starts(texts, 5)):
            assert list(marked) == [i + 5 <= len(t) and seen[t[i : i + 5]] > 1 for i in range(len(t))]


# --- 2: personal data ---------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TEXTS = [
    "a@b.c_d@e.f", "x@y@z.w", "a@b c@d.e @@ a.b@c-d.e-f.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1",
    "4111 1111 1111 1111 1 +1 (555) 123-4567. é😀 a@b.cd", "1" * 5000, "a" * 20000, "1 " * 9000, "+1.......",
    "4111-1111-1111-1111", "+123456789012345678", "😀 +1 212 555 0100 and 10.0.0.1", "a@b", "..@..", None, "",
]


def test_base_spans(make):
    got = {r["doc_id"]: r["spans"] for r in sanitise.found(make(list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i]) == brute_spans(text)


def test_disclosing_terms_are_taken_out(make):
    """A word that stands only beside one address, in different contexts, gives it away."""
    rows = [(i, f"letter {i} for zanzibar person{i} at secret.box@mail.example and more{i} text") for i in range(6)]
    rows += [(100 + i, f"letter for nobody number of text and more words like item{i}") for i in range(60)]
    rows += [(300, None), (301, "")]
    d = make(rows)
    out = {r["doc_id"]: r for r in sanitise.sanitised(d).collect()}
    assert len(out) == len(rows) and out[300]["text"] is None and out[301]["text"] == ""
    assert "zanzibar" not in out[0]["text"] and "[EMAIL]" in out[0]["text"] and "@" not in out[0]["text"]
    assert "letter" in out[0]["text"] and out[100]["text"] == rows[6][1]
    assert out[0]["n_chars"] == len(out[0]["text"]) and out[0]["score"] == 0.5 and out[0]["n.n"] == "x"


def test_sanitise_awkward(spark, make, awkward, tmp_path):
    rows = [*awkward, (40, "mail me: me@here.org"), (40, "mail me: me@here.org")]
    out = collections.Counter(r["text"] for r in sanitise.sanitised(make(rows)).collect())
    assert sum(out.values()) == len(rows) and out["mail me: [EMAIL]"] == 2
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r["doc_id"], r["base_sha256"]) for r in sanitise.op2_sanitise(spark, str(tmp_path)).collect())
    assert got == collections.Counter((i, hashlib.sha256(brute_spans(t).encode()).hexdigest()) for i, t in rows)


# --- 3: benchmark -------------------------------------------------------------------------


def test_leaks_are_found_and_others_left(spark, make, sentence, awkward):
    rng = random.Random(11)

    def rare(n):
        return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n))

    items = [(i, rare(rng.randint(14, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, wanted = [*awkward], set()
    for i in range(100, 160):
        text = sentence(rng, rng.randint(30, 200)) + ". " + rare(30)
        if i % 3 == 0:
            item, words = rng.choice(items[:12]), None
            words = item[1].split()
            if i % 2:  # a paraphrase: a word in nine replaced
                words = [w if n % 9 else "other" for n, w in enumerate(words)]
            text = f"{text} {' '.join(words).title()}. {sentence(rng, 40)}"
            wanted.add((i, item[0]))
        rows.append((i, text))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(rows), benchmark).collect()}
    assert got == wanted
    kept = [r["doc_id"] for r in decontaminate.cleaned(make(rows), benchmark).collect()]
    assert collections.Counter(kept) == collections.Counter(i for i, _ in rows if i not in {d for d, _ in wanted})
    none = benchmark.filter("item_id < 0")
    assert decontaminate.contaminated(make(rows), none).count() == 0
    assert decontaminate.cleaned(make(rows), none).count() == len(rows)


def test_the_svd_sees_every_document(make, sentence, monkeypatch):
    """However many documents there are, the basis is that of the passages of all of them."""
    monkeypatch.setattr(decontaminate, "FIT_DOCUMENTS", 20, raising=False)  # an earlier bound
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(20))) for i in range(60)]
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(600)) for _ in range(60)]
    index = decontaminate.fit(make(list(enumerate(texts))).repartition(5), items)

    def row(words):
        weight = index.weight[words].astype(float)
        return np.bincount(decontaminate._feature(index.vocabulary[words]), weight / np.linalg.norm(weight), decontaminate.DIMENSIONS)

    rows = []
    for text in texts:
        h = decontaminate._item_words(text)
        word, passage, *_ = decontaminate._passages(index.vocabulary, h, np.array([0, len(h)]))
        rows += [row(word[passage == p]) for p in np.unique(passage)]
    found = [textbytes.find(index.vocabulary, decontaminate._item_words(text)) for _, text in items]
    a, own = np.stack(rows), np.stack([row(at[at >= 0]) for at in found])
    rank = decontaminate.RANK + decontaminate.EXTRA
    basis = np.random.default_rng(7).standard_normal((a.shape[1], rank))
    for _ in range(decontaminate.ITERATIONS):
        basis, _ = np.linalg.qr(a.T @ (a @ basis) / len(texts) + own.T @ (own @ basis))
    assert np.linalg.matrix_rank(np.r_[a, own]) > rank
    assert np.abs(basis[:, : decontaminate.RANK] - index.basis).max() < 1e-3


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 90)), rng.integers(0, 5, rng.integers(0, 90))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(a.astype(np.uint64), b.astype(np.uint64)) == table[-1, -1]


# --- 4: lines -----------------------------------------------------------------------------


def test_quality_learns_and_keeps(spark, make, sentence, awkward):
    rng = random.Random(2)
    rows, labels = [*awkward], []
    for i in range(100, 400):
        lines = [sentence(rng, rng.randint(5, 30)).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if bad := i % 4 == 0:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) if i % 8 else "spam " * 40 for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), None))
    table = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = line_quality.scored(make(rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (rest(r["doc_id"], 5) == 0) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["doc_id"] and r["doc_id"] >= 100 and r["held_out"]]
    assert len(right) > 30 and np.mean(right) > 0.95
    by_row = collections.Counter((r["doc_id"], r["score"] >= 0.3) for r in got)
    kept = collections.Counter(r["doc_id"] for r in line_quality.kept(make(rows), table).collect())
    assert kept == collections.Counter({i: n for (i, ok), n in by_row.items() if ok})
    assert {r["score"] for r in line_quality.scored(make(awkward), table.filter("doc_id < 0")).collect()} == {0.5}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    score, chain, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    got, pairs = line_quality.marginals(score, first, chain)
    total = np.zeros((2, 2))
    for a, b in ((0, 4), (4, 9)):
        n, z, good, both = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in range(1 << n):
            y = [labels >> i & 1 for i in range(n)]
            w = math.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1)))
            z += w
            good += w * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += w
        assert np.allclose(got[a:b], good / z)
        total += both / z
    assert np.allclose(pairs, total)


def test_the_pipeline_learns_from_all_labelled_documents(spark, make, sentence, monkeypatch):
    """With more labelled documents than the driver learns from, the field is that of all of them."""
    monkeypatch.setattr(line_quality, "ROUNDS", 12)
    rng = random.Random(14)
    rows = [(i, "\n".join(sentence(rng, 12) if i % 3 else "!! " * rng.randint(1, 9) for _ in range(rng.randint(0, 5)))) for i in range(300)]
    table = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    want, share = line_quality.fit(make(rows), table, 10**6)
    learnt, seen = [], line_quality.fit_all
    monkeypatch.setattr(line_quality, "fit_all", lambda *a: learnt.append(seen(*a)) or learnt[-1])
    assert line_quality.kept(make(rows).repartition(5), table, 20).count() > 0
    (field, empty), = learnt
    assert empty == pytest.approx(share)
    for a, b in ((field.weights, want.weights), (field.chain, want.chain), (field.slope, want.slope), (field.shift, want.shift)):
        assert np.allclose(a, b, atol=1e-6)


# --- 5: languages -------------------------------------------------------------------------


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    seen = collections.Counter()
    for w in words:
        for n in (1, 2, 3):
            s = w if n == 1 else f" {w} "
            seen.update(s[i : i + n] for i in range(len(s) - n + 1))
    return seen


def test_grams_match_brute_force(sentence):
    rng = random.Random(4)
    texts = ["", "  ", "1 2", "a", "Über-Maß, l'été!", "x  y", sentence(rng, 60), "ÀÉ\n\nö 12 z", "a b"]
    key = language_id.grams(texts)
    for i, t in enumerate(texts):
        _, n = np.unique(key[(key >> np.uint64(44)) == i], return_counts=True)
        want = brute_grams(t)
        for w in [g for g in want if g.strip() == ""]:
            del want[w]
        assert sorted(n) == sorted(want.values()), t


def test_languages(make, awkward):
    rng = random.Random(6)
    sounds = {"aa": "kanto mari pelu", "bb": "schr wurz gnex", "cc": "ñué çãolh óixim"}
    rows, langs = [*awkward], {}
    for i in range(100, 220):
        lang = sorted(sounds)[i % 3]
        parts = [sounds[lang][j : j + 2].strip() for j in range(0, 14, 2)]
        rows.append((i, " ".join("".join(rng.choices(parts, k=3)) for _ in range(40))))
        langs[i] = lang
    langs |= {i: None for i, _ in awkward}
    d = make(rows, langs).withColumn("held_out", held_out("doc_id", 4, 2))
    got = language_id.predicted(d).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (rest(r["doc_id"], 4) == 2)
        if r["doc_id"] in langs and langs[r["doc_id"]]:
            assert r["lang_pred"] == langs[r["doc_id"]]
        elif r["doc_id"] in (1, 2, 3):
            assert r["lang_pred"] == "und"
    nothing = language_id.predicted(d.filter("lang is null")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(awkward)


# --- 6: near copies -----------------------------------------------------------------------


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(items, near):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


@pytest.mark.parametrize("bucket", [256, 1])
def test_near_copies(make, sentence, awkward, bucket):
    rng = random.Random(9)
    base = [sentence(rng, 150) for _ in range(6)]
    rows = [*awkward]
    for i in range(100, 160):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = rng.choice(["new", "words"])
        rows.append((i, " ".join(words)))
    prints = [brute_print(t) for _, t in rows]
    roots = brute_groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = collections.Counter((i, p, least.get(r)) for (i, _), p, r in zip(rows, prints, roots))
    got = near_copies.grouped(make(rows), bucket=bucket).collect()
    assert collections.Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want


def test_links_of_fingerprints_that_differ_in_any_bits(spark):
    rng = np.random.default_rng(2)
    fps = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = np.r_[fps, fps ^ (np.int64(1) << rng.integers(0, 63, 40)), fps[:20] ^ np.int64(-(2**63)), ~fps[:10]]
    want = brute_groups(fps.tolist(), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    for bucket in (256, 1):
        got = near_copies.components(near_copies.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 2, bucket))
        root = {r["node"]: r["root"] for r in got.collect()}
        groups, wanted = collections.defaultdict(set), collections.defaultdict(set)
        for x, w in zip(fps.tolist(), want):
            groups[root.get(x, x)].add(x)
            wanted[w].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_thresholds_keep_the_guarantee():
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**62), 2**62, 200)
    for radius in (2, 4):
        for m in range(2, radius + 2):
            groups = near_copies.partitions(np.abs(np.corrcoef(near_copies._bits(fps).T.astype(float))), m)
            assert sorted(i for g in groups for i in g) == list(range(64))
            cost, t = near_copies.allocate(groups, fps, 1000, radius)
            assert math.isinf(cost) or sum(t) == radius - m + 1


def test_deduplicated_keeps_one_of_each_group(make, sentence, awkward):
    rng = random.Random(13)
    rows, group = [*awkward], {}
    for i in range(100, 140):
        text = sentence(rng, 300)
        rows.append((i, text))
        for c in range(i % 4):
            words = text.split()
            words[rng.randrange(300)] = f"edit{c}"
            rows.append((1000 * (c + 1) + i, " ".join(words)))
    kept = wide_copies.deduplicated(make(rows)).collect()
    ids = collections.Counter(r["doc_id"] for r in kept)
    assert {i for i in ids if i and i >= 100} == set(range(100, 140))
    assert ids[5] == 1 and 6 not in ids and ids[1] == 1 and not {2, 3} & set(ids) and None not in ids
    assert all(r["n.n"] == "x" for r in kept)


@pytest.mark.parametrize("block", [wide_copies.BLOCK, 300])
def test_crowded_bucket_loses_no_connection(spark, block):
    """Fingerprints that all share their first bits: each pair near on all bits is connected, and no other."""
    rng = np.random.default_rng(3)
    bits = np.tile(rng.integers(0, 2, 512), (3000, 1))
    bits[:1500, 128:] ^= rng.random((1500, 384)) < 0.25  # some 144 bits from each other
    bits[1500:, 128:] = bits[:1500, 128:]
    for row in bits[1500:]:
        row[128 + rng.choice(384, 75, replace=False)] ^= 1
    bits = bits[rng.permutation(3000)].astype(np.uint8)
    fps = np.packbits(bits, axis=1, bitorder="little")
    nodes = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(fps)], "node long, fp binary")
    found = {tuple(r) for r in wide_copies.links(nodes, block=block).collect()}
    x = bits.astype(np.float32)
    apart = x @ (1 - x).T
    a, b = np.nonzero(np.triu(apart + apart.T <= 83, 1))
    near = set(zip(a.tolist(), b.tolist()))
    assert len(near) >= 1500 and found <= near
    root = list(range(3000))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in found:
        root[max(top(i), top(j))] = min(top(i), top(j))
    assert all(top(i) == top(j) for i, j in near)


# --- 7: licences --------------------------------------------------------------------------


def test_licences(make, awkward):
    mit = license_scan.NOTICES[0][1]
    rows = [
        *awkward, (50, "Under the MIT  License; Apache-License, mit license"), (51, mit.upper()),
        (52, " ".join(w for n, w in enumerate(mit.split()) if n != 20)), (53, "permission is hereby"),
        (54, f"intro {mit} GNU general PUBLIC license"), (55, "mit licenseß ßmit license"),
    ]
    got = collections.Counter(tuple(r) for r in license_scan.scanned(make(rows)).collect())
    by = {r[0]: r for r in got}
    assert sum(got.values()) == len(rows) and max(got.values()) == 2
    assert by[50][1:7] == (8, 3, 2, 6, "apache,mit", "apache,mit") and by[50][7] == 1.0
    assert by[51][2] == 0 and by[51][6] == "mit-text" and by[51][7] == 1.0
    assert by[52][6] == "mit-text" and 0.8 < by[52][7] < 1
    assert by[53][2:] == (0, None, None, "", "", 0.0)
    assert by[54][5] == "gpl" and by[54][6] == "gpl,mit-text" and by[55][2] == 0
    assert by[1][1] == 0


# --- 8: language model --------------------------------------------------------------------


def test_language_model(make, sentence, awkward, monkeypatch):
    monkeypatch.setattr(language_model, "COMMON", 1e-4)
    monkeypatch.setattr(language_model, "SHARE", {2: 1e-4, 3: 1e-4})
    rng = random.Random(8)
    rows = [*awkward, *((i, sentence(rng, 80) + f" only{i}") for i in range(100, 180))]
    d = make(rows).withColumn("held_out", held_out("doc_id", 10, 0))
    got = language_model.scored(d).collect()
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    seen = collections.Counter(w for (i, _), ws in zip(rows, tokens) if rest(i, 10) != 0 for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = collections.Counter(
        (i, rest(i, 10) == 0, len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
        for (i, _), ws in zip(rows, tokens)
    )
    assert want == collections.Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got)
    model, base = (sum(r[k] for r in got if r["held_out"]) for k in ("score", "base_score"))
    assert model > base


@pytest.mark.parametrize("share", [1e-2, 1e-9])
def test_language_model_keeps_every_ngram(make, sentence, awkward, monkeypatch, share):
    """Scores are those of all n-grams seen three times, whatever share of the corpus they make up."""
    monkeypatch.setattr(language_model, "COMMON", share)
    monkeypatch.setattr(language_model, "IN_NGRAMS", share, raising=False)
    monkeypatch.setattr(language_model, "SHARE", {2: share, 3: share})
    rng = random.Random(9)
    phrase = "a phrase that comes again"
    rows = [*awkward, *((i, f"{sentence(rng, 60)} {phrase if i % 20 == 0 else ''} only{i}") for i in range(100, 200))]
    got = language_model.scored(make(rows).withColumn("held_out", held_out("doc_id", 10, 0))).collect()
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in rows]
    seen = [collections.Counter() for _ in range(3)]
    for (i, _), ws in zip(rows, tokens):
        for n in range(1, 4) if rest(i, 10) != 0 else ():
            seen[n - 1].update(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    place = {w: k for k, (w,) in enumerate(seen[0])}
    numbered = [{tuple(place[w] for w in g): c for g, c in level.items() if c >= 3} for level in seen[1:]]
    counts, total = np.array(list(seen[0].values())), sum(seen[0].values())
    m = language_model.build(np.arange(len(counts), dtype=np.uint64), counts, total, len(counts), numbered)
    unseen = math.log10(0.1 / (total + 0.1 * (len(counts) + 1)))
    ids = [np.array([place.get(w, -1) for w in ws]) for ws in tokens]
    want = [m.traverse(x, np.array([0, len(x)]))[0] + unseen * (x < 0).sum() for x in ids]
    assert sorted((r["doc_id"] or 0, round(r["score"], 4)) for r in got) == sorted((i or 0, round(w, 4)) for (i, _), w in zip(rows, want))


def test_language_model_leaves_nothing_it_does_not_read(spark, make, sentence):
    """Counts and levels that only lead to the model are deleted, and shuffles end with their job."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "limpid"
    before = set(folder.glob("*"))
    rng = random.Random(10)
    d = make([(i, sentence(rng, 60)) for i in range(30)]).withColumn("held_out", held_out("doc_id", 10, 0))
    assert language_model.scored(d).count() == 30
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before) == ["arcs", "weighted-words"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("chunk, bucket", [(1 << 21, 1 << 20), (200, 100)])
def test_language_model_by_chunks_and_buckets(make, sentence, awkward, monkeypatch, chunk, bucket):
    """Scores do not depend on how texts and keys are dealt; without n-grams in memory all are asked for."""
    rng = random.Random(13)
    rows = [*awkward, *((i, sentence(rng, 60) + f" only{i}") for i in range(100, 180))]
    d = make(rows).withColumn("held_out", held_out("doc_id", 10, 0))
    by = lambda got: sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"], r["base_score"], r["score"]) for r in got))
    want = by(language_model.scored(d).collect())
    for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("COMMON", 1.0), ("SHARE", {2: 1.0, 3: 1.0})):
        monkeypatch.setattr(language_model, name, value)
    got = by(language_model.scored(d).collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.abs(np.array([x[4:] for x in got]) - np.array([x[4:] for x in want])).max() < 1e-5


@pytest.mark.parametrize("size", [0, 1, 2, 3000])
def test_places(size):
    rng = np.random.default_rng(size)
    table = np.unique(np.r_[rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2), np.arange(size // 100, dtype=np.uint64)])
    keys = np.r_[table, table + np.uint64(1), np.zeros(2, np.uint64), rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([2**64 - 1], np.uint64)]
    assert textbytes.Places(table).find(keys).tolist() == textbytes.find(table, keys).tolist()


def test_automaton_is_a_distribution():
    """From every state the words' probabilities add up to one, with the unseen word's share."""
    rng = random.Random(1)
    text = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(400)]
    seen = [collections.Counter(tuple(text[i : i + n]) for i in range(len(text) - n + 1)) for n in (1, 2, 3)]
    counts = np.array([seen[0][(w,)] for w in range(4)])
    grams = [{g: c for g, c in level.items() if c > 4} for level in seen[1:]]
    grams[1] = {g: c for g, c in grams[1].items() if g[:2] in grams[0] and g[1:] in grams[0]}
    m = language_model.build(np.arange(4, dtype=np.uint64), counts, 400, 4, grams)
    unseen = 0.1 / (400 + 0.1 * 5)
    for prefix in [[], [0], [1], [0, 0], [2, 1], [3, 3, 0]]:
        def score(more):
            ids = np.array(prefix + more)
            return m.traverse(ids, np.array([0, len(ids)]))[0] if len(ids) else 0.0

        start = score([])
        left = 10 ** (score([-1]) - start) * unseen  # failure weights down to the root
        assert abs(sum(10 ** (score([w]) - start) for w in range(4)) + left - 1) < 1e-9


def test_language_model_without_training(make):
    d = make([(None, None), (1, "a b")]).withColumn("held_out", held_out("doc_id", 1, 0) | held_out("doc_id", 1, 1))
    got = {r["doc_id"]: r for r in language_model.scored(d.filter("doc_id = 1")).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["n_tokens"] == 3
    assert got[1]["base_score"] == pytest.approx(0.0)


# --- 9: rules -----------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = collections.Counter(windows)
    again = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
        len(words) < 20 or 100 * len(again) > 30 * len(words),
    )


def test_rules(make, awkward, sentence):
    rng = random.Random(10)
    line = sentence(rng, 12)
    rows = [*awkward, (60, "\n".join([line] * 3 + [sentence(rng, 30), "", " ", ""])), (61, "# a | b $ " * 9), (62, sentence(rng, 200))]
    got = quality_rules.rated(make(rows)).select(*quality_rules.DIGEST).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == collections.Counter((i, *brute_rules(t)) for i, t in rows)
    by = {r["doc_id"]: r["kept"] for r in got}
    assert by[62] and not by[61] and not by[1] and all(not r["kept"] for r in got if r["base_failed"])


# --- 10: mixing ---------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in held]
        if not open_:
            return held
        unit = (total - sum(held.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * unit >= 2 * sizes[s]]
        if not above:
            return held | {s: weight[s] * unit for s in open_}
        held |= {s: 2.0 * sizes[s] for s in above}


def test_mixing(make, awkward, sentence):
    rng = random.Random(12)
    rows = [*awkward, *((i, sentence(rng, 20 + i % 50)) for i in range(100, 700))]
    d = make(rows)
    sized = d.select("doc_id", "source", mixing.size_of().alias("size"))
    targets = {r["source"]: r for r in mixing.source_targets(sized).collect()}
    sizes = collections.Counter()
    for n, (_, t) in enumerate(rows):
        sizes[None if n % 5 == 4 else f"s{n % 3}"] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert set(targets) == set(sizes)
    for s in sizes:
        assert targets[s]["source_size"] == sizes[s] and targets[s]["target"] == pytest.approx(want[s])
    once, again = mixing.mix(d), mixing.mix(d)
    assert once.columns == [c for c in d.columns if c != "copy"] + ["copy"]
    count = lambda x: collections.Counter((r["doc_id"], r["copy"]) for r in x.select("doc_id", "copy").collect())
    assert count(once) == count(again)
    assert {r["copy"] for r in once.select("copy").distinct().collect()} <= {0, 1}


def test_mixing_stops_at_twice_a_source(spark):
    sized = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, "c", 0), (4, None, 5)], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert got == pytest.approx(brute_targets({"a": 10, "b": 1000, "c": 0, None: 5}))
    assert got["a"] == 20 and got["c"] == 0


# --- empty tables -------------------------------------------------------------------------


def test_empty_tables(spark, make):
    d = make([(1, "x")]).filter("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    flag = d.withColumn("held_out", held_out("doc_id", 4, 2))
    for result in (
        repeats.without_repeats(d), sanitise.sanitised(d), decontaminate.contaminated(d, benchmark),
        line_quality.scored(d, labels), language_id.predicted(flag), near_copies.grouped(d), license_scan.scanned(d),
        language_model.scored(flag), quality_rules.rated(d), mixing.mix(d), wide_copies.deduplicated(d),
    ):
        assert result.count() == 0

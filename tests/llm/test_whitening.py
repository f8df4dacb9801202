"""Components and whitened values against a full decomposition of the exact covariance."""

import collections
import math

import numpy as np
import pytest

from limpid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x binary, component int, vector array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, b"", 3, None) for i, v in rows], SCHEMA)


def usable(rows):
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**43 for c in v)]
    lengths = collections.Counter(len(v) for _, v in ok)
    d = max(lengths, key=lambda k: (lengths[k], k)) if lengths else 0
    return [(i, v) for i, v in ok if len(v) == d]


def brute(rows):
    """(kept ids, exact deviations, x, eigenvalues, eigenvectors), all by hand."""
    kept = usable(rows)
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x], float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], deviations, centred, values[::-1], vectors[:, ::-1]


def compare(spark, rows, wanted=8):
    ids, deviations, centred, values, vectors = brute(rows)
    got = whitening.whitened(table(spark, rows).repartition(3), wanted=wanted).collect()
    rank = min(wanted, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == len(ids) * rank
    want = collections.Counter((i, d if d < 2**63 else None) for i, d in zip(ids, deviations))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    assert {r["n"] for r in got} == {len(ids)} and max(r["identity_error"] for r in got) < 1e-9
    for k in range(rank):
        mine = [r for r in got if r["component"] == k + 1]
        assert all(abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9 for r in mine)
        y = centred @ vectors[:, k] / math.sqrt(values[k])
        a = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["whitened"]) for r in mine)
        errors = []
        for sign in (1, -1):
            b = sorted((i is None, i or 0, sign * v) for i, v in zip(ids, y))
            errors.append(max(abs(p[2] - q[2]) for p, q in zip(a, b)))
        assert min(errors) < 1e-7
    return got


def clusters(rng, n, d):
    scale = np.r_[30, 20, 9, 8, 7, 6, 5, 4.5, np.full(max(0, d - 8), 1.0)][:d]
    return (rng.standard_normal((n, d)) * scale / 10).tolist()


@pytest.mark.parametrize("d", [1, 3, 24, 40])
def test_every_width(spark, d):
    rng = np.random.default_rng(d)
    compare(spark, list(enumerate(clusters(rng, 300, d))))


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(clusters(rng, 60, 12)))
    rows += [(100, None), (101, []), (102, [None] * 12), (103, [float("nan")] * 12), (104, [float("inf")] + [0.0] * 11)]
    rows += [(105, [1.0] * 3), (106, [1.0] * 3), (5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (107, [3e38] * 12)]
    compare(spark, rows)


def test_low_rank_has_fewer_components(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-50, 50, (40, 3)).astype(float)
    rows = [(i, [a, b, 0.0, a, b]) for i, (a, b, _) in enumerate(base.tolist())]
    assert {r["component"] for r in compare(spark, rows)} == {1, 2}


def test_integers_beyond_64_bits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(2.0**40 * a), float(b)]) for i, (a, b) in enumerate(rng.standard_normal((2000, 2)))]
    got = compare(spark, rows, wanted=1)
    assert any(r["deviation"] is None for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whitened(table(spark, rows))
    assert out.collect() == [] and "identity_error" in out.columns


def test_the_filter_does_the_work():
    """A flat spectrum takes several filtered rounds; what is left below the cut is damped."""
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    values = np.r_[np.linspace(1.2, 1.05, 8), np.linspace(1.0, 0.7, 192)]
    v = basis * values @ basis.T
    found = whitening.leading(lambda q: v @ q, 200, 8, float(np.trace(v)))
    assert np.abs(found.values - values[:8]).max() < 1e-12
    assert np.abs(np.abs((found.vectors * basis[:, :8]).sum(0)) - 1).max() < 1e-12
    q = rng.standard_normal((200, 24))
    out = np.abs(basis.T @ whitening._filtered(lambda a: v @ a, q, 0.69, 1.0, 1.3, 16)) / np.abs(basis.T @ q)
    assert out[:8].min() > 50 * out[8:].max()


def test_no_convergence_is_an_error():
    rng = np.random.default_rng(5)
    with pytest.raises(ArithmeticError):
        whitening.leading(lambda q: rng.standard_normal((60, 60)) @ q + 9 * q, 60, 8, 60.0)

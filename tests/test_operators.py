import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limpid.operators import charts, correlation, counts, describe, duplicates, fill, frequent, missing, outliers, quantiles, schema

TEN = [100, 101, 102, 103, 104, 105, 106, 102, 103, 120, 900]


@pytest.fixture
def twins(spark):
    return spark.createDataFrame([(i, v, v) for i, v in enumerate(TEN)], "n long, a long, b long")


def test_iqr_bounds(spark, column):
    df = column([1, 2, 3, 4, 5], "x", "long")
    assert outliers.iqr_bounds(df, ["x"]) == {"x": (-1.0, 7.0)}
    assert outliers.iqr_bounds(df, ["x"], 3.0) == {"x": (-4.0, 10.0)}
    assert outliers.iqr_bounds(column([5, 5, 5], "x", "long"), ["x"]) == {}
    assert outliers.iqr_bounds(column([5], "x", "long"), ["x"]) == {}


def test_thresholds_per_column(twins):
    assert outliers.outlier_counts(twins, ["a"])["a"] == 2
    assert outliers.outlier_counts(twins, ["a"], 5.0)["a"] == 1
    out, n = outliers.clip_outliers(twins, ["a", "b", "absent"], {"a": 5.0})
    assert n == {"a": 1, "b": 2}
    assert out.agg(F.max("b")).first()[0] == 110  # floor of 110.75: inside the fence
    only, n = outliers.clip_outliers(twins, ["a"])
    assert n == {"a": 2} and only.agg(F.max("b")).first()[0] == 900


def test_profile_has_no_flat_guard(column):
    df = column([5.0] * 10 + [6.0], "x", "double")
    assert outliers.profile_outliers(df, ["x"]).first()["n_outliers"] == 1
    assert outliers.outlier_counts(df, ["x"]) == {"x": 0}


def test_latent_outliers(column):
    df = column([f"{v},50 €" for v in range(100, 110)] + ["50000,00 €"], "m")
    rows = outliers.outlier_summary(df.select("m"), ["m"]).collect()
    assert [(r["column"], r["n_outliers"], r["latent"]) for r in rows] == [("m", 1, True)]


@pytest.mark.parametrize("seed, skew", [(1, False), (2, True)])
def test_quantiles_by_narrowing_equal_numpy(spark, seed, skew):
    rnd = np.random.default_rng(seed)
    x = rnd.lognormal(3, 2, 20_000)
    if skew:
        x[rnd.random(20_000) < 0.4] = 7.0       # one value holds over a third of the rows
    y = rnd.integers(0, 5, 20_000).astype(float)
    pdf = pd.DataFrame({"x": x, "y": y})
    pdf.loc[::7, "y"] = np.nan
    df = schema.nan_to_null(spark.createDataFrame(pdf).repartition(5))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = quantiles.quantiles(df, ["x", "y"], probs, direct_cells=0, fetch_values=50, accuracy=100)
    direct = quantiles.quantiles(df, ["x", "y"], probs)
    for c in ("x", "y"):
        want = np.quantile(pdf[c].dropna(), probs)
        assert np.allclose(found[c], want) and np.allclose(direct[c], want)


def test_quantiles_of_nothing(column):
    df = column([None, None], "x", "double")
    assert quantiles.quantiles(df, ["x"], (0.5,), direct_cells=-1) == {"x": (None,)}


def test_duplicates_keep_first_and_nulls_match(spark):
    rows = [(1, "a", None), (1, "a", None), (2, None, "a"), (2, "a", None), (1, "a", None)]
    df = spark.createDataFrame(rows, "x long, y string, z string")
    out, n = duplicates.drop_duplicates(df)
    assert n == 2 and out.count() == 3
    assert duplicates.duplicate_count(df).first()[0] == 2


def test_duplicates_with_hot_group_and_small_broadcast(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1500).alias("k"))
    want = df.distinct().count()
    for limit in (0, 10_000):
        out, n = duplicates.remove_duplicates(df, broadcast_limit=limit)
        assert out.count() == want and n == 3000 - want


def test_duplicates_keep_smallest_row_id(spark):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (4, "b")], "row long, v string")
    out, n = duplicates.remove_duplicates(df, row="row")
    assert n == 1 and {(r["row"], r["v"]) for r in out.collect()} == {(3, "a"), (4, "b")}


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (None, 3), (4.0, 4)], "a double, b long")
    (row,) = missing.missing_summary(df).collect()
    assert (row["column"], row["n_missing"], row["pct_missing"]) == ("a", 2, 50.0)
    assert [r["pct_missing"] for r in missing.null_profile(df).collect()] == [50.0, 0.0]


def test_near_empty_columns(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 5, 1).alias("at95"), F.when(F.col("id") < 6, 1).alias("at94"))
    out, gone = missing.drop_near_empty_columns(df)
    assert gone == ["at95"] and out.columns == ["id", "at94"]


def test_fill(spark):
    rows = [(1, 1.0, "b", "x"), (2, None, "a", None), (4, 4.0, "b", None), (None, 9.0, "a", None)]
    df = spark.createDataFrame(rows, "i long, f double, s string, t string").union(
        spark.createDataFrame([(None, None, None, None)], "i long, f double, s string, t string")
    )
    out, fills = fill.fill_missing(df)
    assert {c: (f.value, f.count) for c, f in fills.items()} == {
        "i": ("2", 2), "f": ("4.0", 2), "s": ("a", 1), "t": ("x", 4),
    }
    assert missing.missing_summary(out).count() == 0


def test_fill_fractional_median_widens_integers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i long")
    out, fills = fill.fill_missing(df)
    assert out.dtypes == [("i", "double")] and sorted(r[0] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_fill_all_null_text(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "s string, k long")
    out, _ = fill.fill_missing(df)
    assert {r["s"] for r in out.collect()} == {"Inconnu"}


def test_categories(spark):
    df = spark.createDataFrame([("a",)] * 19 + [("b",)] + [(None,)] * 5, "s string")
    vc = counts.value_counts(df)
    r = counts.categorical_profile(vc).first()
    assert (r["cardinality_absolute"], r["cardinality_relative"], r["sparsity_ratio"]) == (2, 8.0, 80.0)
    assert r["skewness_frequency"] == 95.0 and r["is_high_skewness"]
    assert [(x["value"], x["n"]) for x in counts.top_values(vc).orderBy("n").collect()] == [("b", 1), ("a", 19)]


def test_mode_tie_is_the_smallest(column):
    vc = counts.value_counts(column(["b", "a", "b", "a", "c"]), ["v"])
    assert counts.modes(vc).first()["value"] == "a"


def plain_top(values, n):
    seen = collections.Counter(v for v in values if v is not None)
    return sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:n]


def top_of(df, **options):
    out = collections.defaultdict(list)
    for r in frequent.top_values_of(df, **options).collect():
        out[r["column"]].append((r["value"], r["n"]))
    return {c: sorted(v, key=lambda x: (-x[1], x[0].encode())) for c, v in out.items()}


@pytest.mark.parametrize("tracked", [2000, 4])
@pytest.mark.parametrize("seed", range(2))
def test_top_values_are_exact(spark, monkeypatch, seed, tracked):
    """Hot, flat, unique and long values, ties on the last place and on a long common start."""
    monkeypatch.setattr(frequent, "FETCHED", 3 if seed else 100_000)
    rng = random.Random(seed)
    head = "one and the same beginning of all of these texts, "
    columns = {
        "hot": ["x"] * 200 + [f"v{i}" for i in range(200)],
        "flat": [f"w{i % 25:02d}" for i in range(400)],
        "unique": [f"id{i:03d}" for i in range(400)],
        "long": [head + str(rng.randint(0, 30)) for _ in range(400)],
        "texts": [f"{rng.randint(0, 9)} {head}{i}" for i in range(400)],
        "mixed": [rng.choice([head[:32], head[:33], head, "short", None]) for _ in range(400)],
        "none": [None] * 400,
    }
    rows = list(zip(*columns.values()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(5)
    want = {c: plain_top(v, 7) for c, v in columns.items() if c != "none"}
    assert top_of(df, n=7, tracked=tracked) == want


def test_a_sketch_proves_only_what_its_bound_allows(spark):
    assert frequent.missed_at_most(1000, 2000) == 2 * 3.5 / 4096 * 1000
    df = spark.createDataFrame([(f"v{i % 3000}",) for i in range(9000)], "s string")
    exact, present = frequent.sketched_counts(df, ["s"], 4)
    assert present == {"s": 9000} and exact.count() < 3000
    assert {n for _, n in top_of(df, n=3, tracked=4)["s"]} == {3}


def test_no_values_no_top(spark):
    assert top_of(spark.createDataFrame([], "a string")) == {}
    assert top_of(spark.range(3)) == {}


def test_format_anomalies(spark):
    df = spark.createDataFrame([("Paris", "x ", "AB"), ("paris", "y", "CD"), ("LYON", "z", "EF")], "a string, b string, c string")
    found = {r["column"]: (r["space_anomaly"], r["case_anomaly"]) for r in counts.format_anomalies(df).collect()}
    assert found == {"a": (True, True), "b": (True, False), "c": (False, False)}


def test_identifier_columns(spark):
    rows = [(f"id{i}", "ab"[i % 2], f"v{i if i > 4 else 0}") for i in range(50)]
    df = spark.createDataFrame(rows, "id string, s string, almost string")
    found = {r["column"]: r["is_identifier"] for r in counts.identifier_columns(df).collect()}
    assert found == {"id": True, "s": False, "almost": True}
    few = counts.identifier_columns(df.limit(10)).filter("is_identifier")
    assert few.count() == 0


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "`x.y` string, `z w` double")
    assert counts.value_counts(df).count() == 2
    assert {r["column"]: r["n_missing"] for r in missing.null_profile(df).collect()} == {"x.y": 0, "z w": 1}
    assert counts.column_overview(df).count() == 2


def test_row_alerts(spark):
    rows = [(i, None, None, 1) for i in range(12)] + [(None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, a long, b long, c long, d long").select(
        "a", "b", "c", "d", F.col("n")
    )
    r = missing.row_quality(df.drop("n")).first()
    assert (r["full_empty"], r["partially_empty"]) == (1, 12)
    every = {x["percentage"]: (x["n_rows"], x["rows"]) for x in missing.row_alerts(df, "n").collect()}
    assert every == {40.0: (12, list(range(10))), 80.0: (1, [12])}


def test_describe_and_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, True), (2, 4.0, False), (3, 6.5, True), (None, 1.0, None)], "a long, b double, c boolean")
    rows = {r["column"]: r for r in describe.describe_numeric(df).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["q50"] == 2.0 and rows["b"]["count"] == 4
    r = {(x["column_x"], x["column_y"]): x["correlation"] for x in correlation.correlation_matrix(df).collect()}
    assert r[("a", "a")] == 1.0 and r[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    with pytest.raises(ValueError):
        correlation.correlation_matrix(df, ["a"])


def test_empty_table_cannot_be_profiled(spark):
    with pytest.raises(ValueError):
        describe.shape(spark.createDataFrame([], "a long"))


def test_histograms(column):
    df = column([float(i) for i in range(101)], "x", "double")
    rows = charts.histogram(df, "x").collect()
    assert len(rows) == 20 and sum(r["n"] for r in rows) == 101
    want, _ = np.histogram(np.arange(101.0), 20)
    assert [r["n"] for r in sorted(rows, key=lambda r: r["bin"])] == list(want)
    auto = charts.histogram(df, "x", None).count()
    assert auto == len(np.histogram_bin_edges(np.arange(101.0), "auto")) - 1


def test_one_far_value_does_not_multiply_bins(column):
    values = [i / 1000 for i in range(2000)] + [1e9]
    got = charts.histogram(column(values, "x", "double"), "x", None)
    assert got.count() == len(np.histogram_bin_edges(np.array(values), "auto")) - 1 < 100


def test_density_matches_direct_sum(column):
    x = np.array([1.0, 2.0, 2.5, 7.0])
    rows = sorted(charts.density(column(x.tolist(), "x", "double"), "x", 5).collect())
    h = x.std(ddof=1) * 4 ** -0.2
    for r in rows:
        want = np.exp(-0.5 * ((r["x"] - x) / h) ** 2).sum() / (4 * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want)


def test_scatter_points_use_complete_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0)], "a long, b double")
    assert charts.scatter_points(df).count() == 1
    with pytest.raises(ValueError):
        charts.scatter_points(df, ["a"])


@pytest.mark.parametrize("block", [1024, 3])
def test_correlation_equals_numpy_on_shared_rows(spark, block):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 7)) * [1, 1e6, 1, 1, 1, 1, 0] + [0, 1e9, 0, 5, 0, 0, 0.1]
    x[:, 2] += x[:, 0]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 5] = np.nan
    x[:2, 5] = [1.0, 2.0]
    x[0, 3] = np.inf
    names = [f"c.{i}" for i in range(7)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(6)
    got = {(r["column_x"], r["column_y"]): r["correlation"] for r in correlation.correlation_matrix(df, block=block).collect()}
    assert len(got) == 49
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            u, v = x[both, i], x[both, j]
            if len(u) < 2 or u.std() == 0 or v.std() == 0 or 6 in (i, j):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)


def test_correlation_of_many_columns_is_one_scan(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    wide = spark.range(50).select(*[(F.rand(i) + F.col("id")).alias(f"c{i}") for i in range(300)])
    out = correlation.correlation_matrix(wide.mapInArrow(run, wide.schema))
    assert seen.value == 50 and out.count() == 300 * 300


def test_density_stays_within_its_error(column):
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 1, 400), rng.normal(30, 0.2, 100), [1e4]]
    rows = charts.density(column(x.tolist(), "x", "double"), "x", 150).collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    assert charts.series_error() < 4e-12
    for r in rows:
        want = np.exp(-0.5 * ((r["x"] - x) / h) ** 2).mean()
        assert abs(r["density"] * h * np.sqrt(2 * np.pi) - want) < charts.series_error() + 1e-12


def test_scatter_sample_does_not_depend_on_partitions(spark):
    rows = [(i, float(i % 7) if i % 5 else None, i * 2) for i in range(300)] + [(None, 1.0, 2)]
    df = spark.createDataFrame(rows, "id long, a double, b long")
    want = sorted(charts.scatter_sample(df, "id", 40).collect())
    assert len(want) == 40 and all(r["a"] is not None for r in want)
    for n in (1, 3, 11):
        assert sorted(charts.scatter_sample(df.repartition(n, F.rand(n)), "id", 40).collect()) == want
    halves = [charts.scatter_sample(df.filter(f"id % 2 = {k}"), "id", 40) for k in (0, 1)]
    assert sorted(charts.scatter_sample(halves[0].unionByName(halves[1]), "id", 40).collect()) == want
    assert charts.scatter_sample(df, "id", 10_000).count() == 240
    assert charts.scatter_sample(df.limit(0), "id", 5).count() == 0


def test_sketches_of_parts_unite(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("v"), (F.col("id") % 9).alias("day"), F.lit(None).cast("string").alias("none"))
    parts = counts.distinct_sketches(df, ["v", "none"], by=F.col("day"))
    assert parts.count() == 18
    found = {r["column"]: r for r in counts.united_sketches(parts).collect()}
    assert abs(found["v"]["n_distinct_estimate"] / 5000 - 1) <= counts.sketch_bound() and found["v"]["n_present"] == 20_000
    assert (found["none"]["n_present"], found["none"]["n_distinct_estimate"]) == (0, 0)


@pytest.mark.parametrize("limit", [duplicates.BROADCAST_FINGERPRINTS, 0])
def test_duplicate_count_with_and_without_broadcast(spark, limit):
    rows = [(1, None), (1, None), (1, "a"), (None, "a"), (None, "a"), (None, "a"), (2, "b")]
    df = spark.createDataFrame(rows, "a long, b string")
    assert duplicates.duplicate_count(df, limit).first()[0] == 3
    assert duplicates.duplicate_count(df.limit(0), limit).first()[0] == 0


def test_long_values_are_compared_by_digest(spark):
    long = "Long text that goes on and on, far beyond thirty-two characters"
    df = spark.createDataFrame([(long,), (long.lower(),), (long.upper(),), ("short",)], "v string")
    assert counts.format_anomalies(df).first()["case_anomaly"]

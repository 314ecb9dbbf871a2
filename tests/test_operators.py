"""Operators against naive versions on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import kernels as K
from tessitura.operators import arrays as A
from tessitura.operators import graphs as G
from tessitura.operators import learn as M
from tessitura.operators import points as P
from tessitura.operators import samples as S


def _signal(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "signal_id string, n int, x double")


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(95, 40, 0.5, 4), (95, 100, 0.5, 1), (100, 50, 0.5, 3)])
def test_frame_counts(spark, n, size, overlap, want):
    out = S.chunk(_signal(spark, range(n)), size, overlap)
    assert out.select("frame").distinct().count() == want and out.count() == want * size


@pytest.mark.parametrize("lags", [list(range(5)), [-3, -1, 0, 2], [-4, 0, 7]])
def test_convolution_equals_loops_and_toeplitz(spark, lags):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(2, 60)), rng.normal(size=(2, len(lags)))
    want = [sum(x[c, t - lag] * w[c, i] for c in range(2) for i, lag in enumerate(lags) if 0 <= t - lag < 60) for t in range(60)]
    samples = _signal(spark, x[0], "a").union(_signal(spark, x[1], "b"))
    taps = [("ab"[c], lag, w[c, i]) for c in range(2) for i, lag in enumerate(lags)]
    got = S.fast_conv(samples, taps).orderBy("n").toPandas()["y"]
    assert np.abs(got - want).max() < 1e-8
    flat = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w.ravel())], '"column" int, w double'.replace('"', "`"))
    product = S.toeplitz(samples, lags, bias=False).join(flat, "column").groupBy("n").agg(F.sum(F.col("value") * F.col("w")).alias("y")).orderBy("n").toPandas()["y"]
    assert np.abs(product - want).max() < 1e-8


def test_events_and_peaks(spark):
    x = [0, 2, 0, 0, 3, 5, 4, 0, 1, 1]
    got = {tuple(r) for r in S.break_into_events(_signal(spark, x)).select("start", "end", "max_amp").collect()}
    assert got == {(1, 2, 0.0), (4, 7, 5.0), (8, 9, 1.0)}
    merged = {tuple(r) for r in S.break_into_events(_signal(spark, x), merge=2, least_peak=1).select("start", "end").collect()}
    assert merged == {(4, 9)}
    peaks = [r["n"] for r in S.detect_peaks(_signal(spark, [0, 1, 0, 2, 0, 3, 0, 2, 2, 0]), distance=2).orderBy("n").collect()]
    assert peaks == [1, 5]
    flat = [r["n"] for r in S.detect_peaks(_signal(spark, [0, 2, 2, 0]), edge="falling").collect()]
    assert flat == [2]


def test_range_join_finds_every_pair(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random(80) * 10, rng.random(70) * 10
    left, right = (spark.createDataFrame([(float(v),) for v in x], "t double") for x in (a, b))
    got = sorted((r["t1"], r["t2"]) for r in P.range_pairs(left, right, 0.3).collect())
    assert got == sorted((x, y) for x in a for y in b if abs(x - y) <= 0.3)
    assert P.joint_isi(left, right, 0.6, 0.1).agg(F.sum("count")).first()[0] <= len(got)


def test_coherence_of_filtered_noise(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=64 * 60)
    y = x + rng.normal(size=len(x))
    out = A.multitaper_coherence(_signal(spark, x, "a").union(_signal(spark, y, "b")), 64, 64, 0.5, 3).toPandas()
    assert abs(out["coherence"].mean() - 0.5) < 0.08
    assert (out["lower"] <= out["coherence"] + 1e-12).all() and (out["upper"] >= out["coherence"] - 1e-12).all()


def test_ridge_recovers_a_filter(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 300))
    samples = _signal(spark, x[0], "a").union(_signal(spark, x[1], "b"))
    taps = [("a", 0, 1.0), ("a", 1, -0.5), ("b", 1, 2.0)]
    target = S.fast_conv(samples, taps, 0.7)
    w, bias = M.strf_ridge(samples, target, [0, 1], 1e-9)
    assert np.allclose(w, [[1, -0.5], [0, 2]], atol=1e-6) and abs(bias - 0.7) < 1e-6


def test_kernels_do_not_depend_on_partitions(spark):
    s = _signal(spark, np.sin(np.arange(200) / 5)).repartition(8)
    got = A.spread(A.gather(s).select("signal_id", A.lowpass("x", 100.0, 10.0).alias("x"))).orderBy("n").toPandas()["x"]
    assert np.allclose(got, K.lowpass(np.sin(np.arange(200) / 5), 100.0, 10.0))


def test_communities_of_two_cliques():
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    w[3, 4] = w[4, 3] = 0.1
    np.fill_diagonal(w, 0)
    s = w.sum(axis=1)
    tree = G.communities(w - np.outer(s, s) / s.sum())
    assert sorted(G.leaves(tree)) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert G.leaves(tree, 5) == [list(range(8))]
    assert len({tuple(sorted(np.flatnonzero(G.spectral_clusters(w + np.eye(8) * 1e-3, 2) == k))) for k in (0, 1)} & {(0, 1, 2, 3), (4, 5, 6, 7)}) == 2


def test_page_rank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 2.0), ("a", "d", 1.0)], "src string, dst string, weight double")
    rank = G.page_rank(edges, iterations=20).toPandas()
    assert abs(rank["rank"].sum() - 1) < 1e-9 and len(rank) == 4


def test_thinned_peaks_equal_the_definition():
    rng = np.random.default_rng(4)
    for keep_same in (False, True):
        for _ in range(50):
            at = np.sort(rng.choice(60, 20, False)).tolist()
            heights = {int(n): float(rng.integers(0, 5)) for n in at}
            kept, dead = [], set()
            for n in sorted(heights, key=lambda n: (-heights[n], -n)):
                if n not in dead:
                    kept.append(n)
                    dead |= {m for m in heights if abs(m - n) <= 4 and m != n and (heights[m] < heights[n] or not keep_same)}
            assert S.thin_peaks(heights, 4, keep_same) == sorted(kept)


def test_neighbour_measures_of_many_cells(spark, monkeypatch):
    from tessitura.functions import learn_kernels as L
    from tessitura.operators import neighbours as N

    monkeypatch.setattr(M, "KNN_ROWS", 10)
    monkeypatch.setattr(N, "CELL_ROWS", 75)
    rng = np.random.default_rng(3)
    # with ties of x, and more of y
    rows = np.column_stack([rng.integers(-100, 900, 300), rng.integers(0, 5, 300), np.arange(300)])
    a, b, c = (v[:, None] for v in rows[np.lexsort(rows.T[::-1])].T)
    got = M.knn_measures(spark.createDataFrame([tuple(map(float, v)) for v in rows], "x double, y double, z double"), ["x"], ["y"], ["z"]).first()
    assert np.allclose(list(got), [L.knn_entropy(a), L.knn_mi(a, b), L.knn_cmi(a, b, c), L.knn_kl(a, b)], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("kind", ["spread", "tied", "odd"])
def test_exact_percentiles_equal_sparks(spark, kind):
    from tessitura.operators import statistics as T

    rng = np.random.default_rng(5)
    x = {"spread": np.exp(rng.normal(size=2000) * 20), "tied": rng.integers(0, 4, 2000) / 7, "odd": np.concatenate([rng.normal(size=20), [np.inf, -np.inf, np.nan, 1.7e308, -1.7e308, 0.0, 5e-324]])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    shares = [0.0, 0.09, 0.27, 0.5, 0.81, 1.0]
    want = df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    assert np.array_equal(T.exact_percentiles(df, "x", shares), want, equal_nan=True)
    assert T.exact_percentiles(df.filter("x is null"), "x", shares) == []


def test_quantile_bins_hold_no_column_in_one_task(spark):
    from tessitura.operators import statistics as T

    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    binned = T.binned_mean(df, "x", "y", 10, True)
    assert "percentile" not in binned._jdf.queryExecution().toString()
    assert sorted(r["count"] for r in binned.collect()) == [90] * 9 + [189]


def test_smoothed_bins_hold_no_column_in_one_task(spark):
    from tessitura.operators import statistics as T

    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    smoothed = T.smooth_bins(T.binned_mean(df, "x", "y", 10, True), 5)
    assert "percentile" not in smoothed._jdf.queryExecution().toString() and smoothed.count() == 5


def test_discrete_information_of_a_tied_class_equals_sql(spark):
    import duckdb
    import pandas as pd

    from tessitura.plans import registry

    customer = pd.DataFrame({"c_acctbal": [5.0] * 6 + [0.5 * i * i for i in range(20)], "c_mktsegment": ["tied"] * 6 + ["spread"] * 20})
    con = duckdb.connect()
    con.register("customer", customer)
    want = con.execute(registry.ORACLES["q_discrete_information"]).fetchone()[0]
    got = M.discrete_information(spark.createDataFrame(customer.rename(columns={"c_acctbal": "x", "c_mktsegment": "y"}))).first()[0]
    assert abs(got - want) < 1e-6

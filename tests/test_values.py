"""Queries without SQL against values found another way: design matrices and eigenvalues in NumPy, optimality, invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import kernels as K
from tessitura.functions import learn_kernels as L
from tessitura.plans import registry
from tessitura.plans.tables import signal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = registry.QUERIES[name](spark, SF).toPandas()
        return held[name]

    return get


@pytest.fixture(scope="module")
def design(spark):
    """(X with ones last, y) of the filter queries: four channels at lags 0, 1, 2."""
    wide = signal(spark, SF, True).toPandas().pivot(index="n", columns="signal_id", values="x")
    y = wide.pop("click").to_numpy()
    x = wide[sorted(wide.columns)].to_numpy()
    cols = [np.concatenate([np.zeros(lag), x[: len(x) - lag, c]]) for c in range(x.shape[1]) for lag in (0, 1, 2)]
    return np.array([*cols, np.ones(len(y))]).T, y


def _weights(frame):
    own = frame[frame["channel"] >= 0].sort_values(["channel", "lag"])["w"].to_numpy()
    return np.append(own, frame[frame["channel"] < 0]["w"].iloc[0])


def test_ridge_filter(run, design):
    x, y = design
    w = _weights(run("q_strf_ridge"))
    xc, yc = x[:, :-1] - x[:, :-1].mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(12), xc.T @ yc)
    assert np.allclose(w[:-1], want, atol=1e-6) and math.isclose(w[-1], y.mean() - x[:, :-1].mean(axis=0) @ want, rel_tol=1e-6)


def _optimal(x, y, w, l1, l2=0.0, signs=None):
    """Whether w meets the conditions of the least penalised squares."""
    slope = x.T @ (y - x @ w) - l2 * w
    scale = 1e-4 * max(1.0, np.abs(x.T @ y).max())
    for s, v, sign in zip(slope, w, signs if signs is not None else np.zeros(len(w)), strict=True):
        if sign:
            s, v = s * sign, v * sign
            assert v >= 0 and (abs(s - l1) <= scale if v > 0 else s <= l1 + scale)
        else:
            assert abs(s - l1 * np.sign(v)) <= scale if v else abs(s) <= l1 + scale


def test_lasso_is_optimal(run, design):
    _optimal(*design, _weights(run("q_strf_lasso")), 1e5, 1.0)


def test_active_set_is_optimal(run, design):
    _optimal(*design, _weights(run("q_in_crowd")), 1e5)


def test_sign_constraints_are_met_and_optimal(run, design):
    w = run("q_sign_constrained").sort_values("i")["w"].to_numpy()
    _optimal(*design, w, 200.0, signs=np.where(np.arange(13) % 2, -1.0, 1.0))


def test_descent_lowers_the_error(run, design):
    x, y = design
    w = _weights(run("q_threshold_descent"))
    assert ((y - x @ w) ** 2).sum() < (y**2).sum() and np.isfinite(w).all()


def test_effective_degrees(run, design):
    s = np.linalg.svd(design[0], compute_uv=False)
    assert math.isclose(run("q_effective_dof")["dof"].iloc[0], (s**2 / (s**2 + 1e6)).sum(), rel_tol=1e-6)


def test_complex_components(run, spark):
    e = np.array([r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("embedding is not null").select("embedding").collect()], float)
    parts = (e - e.mean(axis=0)) / e.std(axis=0, ddof=1)
    z = parts[:, :32] + 1j * parts[:, 32:64]
    want = np.sort(np.linalg.eigvalsh(z.conj().T @ z / len(z)))[::-1]
    assert np.allclose(run("q_complex_pca").sort_values("component")["value"], want, rtol=1e-6)


def test_discrimination(run, spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold")).toPandas()
    x, y, fold = np.array(rows["embedding"].tolist(), float), rows["label"].to_numpy(), rows["fold"].to_numpy()
    names = sorted(c for c in set(y) if (y == c).sum() >= 6)
    keep = np.isin(y, names)
    x, y, fold = x[keep], y[keep], fold[keep]
    k = max(1, min(x.shape[1], int(np.sqrt(len(x) // 5))))
    z = (x - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :k]
    sums, counts, hits = {}, {}, {}
    for f in range(5):
        train, test = fold != f, fold == f
        own = [c for c in names if (y[train] == c).sum() >= 5]
        means = {c: z[train & (y == c)].mean(axis=0) for c in own}
        used = train & np.isin(y, own)
        eye = np.eye(k) * 1e-6 * z[used].var(axis=0).mean()
        pooled = sum((z[used & (y == c)] - means[c]).T @ (z[used & (y == c)] - means[c]) for c in own) / (used.sum() - len(own)) + eye
        for method in ("LDA", "QDA"):
            logs = []
            for c in own:
                cov = pooled if method == "LDA" else np.cov(z[used & (y == c)].T).reshape(k, k) + eye
                dev = z[test] - means[c]
                logs.append(-0.5 * np.einsum("ij,jk,ik->i", dev, np.linalg.inv(cov), dev) - 0.5 * np.linalg.slogdet(cov)[1])
            p = np.exp(np.array(logs).T - np.max(logs, axis=0)[:, None])
            p /= p.sum(axis=1, keepdims=True)
            for truth, row in zip(y[test], p, strict=True):
                if truth in own:
                    for j, c in enumerate(own):
                        sums[method, truth, c] = sums.get((method, truth, c), 0) + row[j]
                        counts[method, truth, c] = counts.get((method, truth, c), 0) + 1
                        hits[method, truth, c] = hits.get((method, truth, c), 0) + (row.argmax() == j)
    got = {(r.method, r.truth, r.predicted): (r.p, r.count_) for r in run("q_discriminate").rename(columns={"count": "count_"}).itertuples()}
    assert got.keys() == sums.keys()
    for key, (p, count) in got.items():
        assert abs(p - sums[key] / counts[key]) < 2e-5 and abs(count - hits[key]) <= 1, key
    for r in run("q_discriminate_summary").itertuples():
        right = sum(v[1] for key, v in got.items() if key[0] == r.method and key[1] == key[2])
        assert r.correct == right and math.isclose(r.p_value, K.binomial_tail(int(right), int(r.n), r.chance), rel_tol=1e-9)


def test_shuffles(run, spark):
    rows = spark.read.parquet(f"{SF}/nation.parquet").toPandas().astype({"n_nationkey": float, "n_regionkey": float}).sort_values(["n_nationkey", "n_regionkey"])
    x, y = rows["n_nationkey"].to_numpy(), rows["n_regionkey"].to_numpy()
    values = [L.knn_mi(np.random.default_rng([0, i]).permutation(x)[:, None], y[:, None]) for i in range(50)]
    got = run("q_shuffle_test").iloc[0]
    assert np.allclose([got["mean"], got["lower"], got["upper"]], [np.mean(values), *np.percentile(values, [2.5, 97.5])], atol=1e-9)


def test_communities_and_clusters(run, spark):
    nodes = {r[0] for r in spark.read.parquet(f"{SF}/nation.parquet").select("n_nationkey").collect()}
    for name, column in (("q_communities", "community"), ("q_spectral_clusters", "cluster")):
        got = run(name)
        assert set(got["node"]) <= nodes and got["node"].is_unique and got[column].notna().all()
    assert run("q_spectral_clusters")["cluster"].nunique() <= 3


def test_multitaper_frames(run, spark):
    wide = signal(spark, SF, True).toPandas().pivot(index="n", columns="signal_id", values="x")
    got = run("q_multitaper_stft")
    name = wide.columns[0]
    x, size = np.pad(wide[name].to_numpy(), 48), 97
    tapers, share = K.dpss(size, 3, 5)
    for t in (0, 7, 20):
        own = x[24 * t : 24 * t + size]
        spec = np.array([np.abs(np.fft.fft(own * w)) ** 2 for w in tapers])
        out = spec[:2].mean(axis=0)
        for _ in range(150):
            w = np.sqrt(share)[:, None] * out / (share[:, None] * out + (1 - share[:, None]) * own.var())
            out = (w**2 * spec).sum(axis=0) / (w**2).sum(axis=0)
        rows = got[(got["signal_id"] == name) & (got["t_idx"] == t)].sort_values("f_idx")
        assert np.allclose(rows["re"], out[: len(rows)], rtol=1e-3)


def test_modes_of_many_kinds(run):
    ensemble = run("q_ensemble_modes")
    assert (ensemble["sd"] >= 0).all() and np.isfinite(ensemble["mean"]).all()
    for name in ("q_empirical_modes", "q_multichannel_modes"):
        assert np.isfinite(run(name)["value"]).all() and run(name)["imf"].nunique() > 1


def test_simulated_trains(run, spark):
    rate = signal(spark, SF).agg(F.sum(F.greatest(F.col("x") / 2000, F.lit(0.0)))).first()[0]
    for name in ("q_simulate_poisson", "q_simulate_gamma"):
        got = run(name).groupby("trial").size()
        assert len(got) == 10 and abs(got.mean() - rate) < 6 * math.sqrt(rate / 10) + 0.2 * rate, name


def test_random_rates(run):
    got = run("q_random_psth")
    assert len(got) == 1000 and (got["rate"] >= 0).all() and got["n"].is_unique
    # noise over the threshold has mean 0.352, and the kernel has area 1
    assert abs(got["rate"].mean() - 0.352) < 0.1


def test_radial_fit_beats_the_mean(run, spark):
    fit = run("q_radial_fit").sort_values("i")
    assert len(fit) == 3 and (fit["width"] > 0).all() and (np.diff(fit["center"]) > 0).all()


def test_smoothed_bins_pass_through_the_means(run, spark):
    from tessitura.operators import statistics as T

    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    bins = T.binned_mean(lines, "l_extendedprice", "l_quantity", 10, True).toPandas().sort_values("center")
    got = run("q_smooth_bins").sort_values("i")
    assert len(got) == 50 and math.isclose(got["mean"].iloc[0], bins["mean"].iloc[0], rel_tol=1e-9) and math.isclose(got["mean"].iloc[-1], bins["mean"].iloc[-1], rel_tol=1e-9)


def test_neighbour_measures(run, spark):
    rows = spark.read.parquet(f"{SF}/supplier.parquet").select("s_acctbal", "s_nationkey", "s_suppkey").toPandas().astype(float).sort_values(["s_acctbal", "s_nationkey", "s_suppkey"])
    a, b, c = (rows[[v]].to_numpy() for v in rows.columns)
    got = run("q_knn_measures").iloc[0]
    assert np.allclose([got["entropy"], got["mutual"], got["conditional"]], [L.knn_entropy(a), L.knn_mi(a, b), L.knn_cmi(a, b, c)])


def test_surrogates_and_inversion(run):
    assert np.isfinite(run("q_surrogates")["x"]).all() and np.isfinite(run("q_griffin_lim")["x"]).all()


def test_features_and_formants(run):
    got = run("q_sound_features")
    assert len(got) == 5 and (got["rms"] > 0).all() and (got["hashid"].str.len() == 32).all()
    formants = run("q_formants")
    ordered = formants.dropna()
    assert len(formants) and (ordered["f1"] <= ordered["f2"]).all() and (ordered["f2"] <= ordered["f3"]).all()


def test_spectral_gaps(run, spark):
    from tessitura.operators import graphs as G
    from tessitura.plans.tables import nation_edges

    w, _ = G.weight_array(nation_edges(spark, SF))
    values = np.linalg.eigvals(w / w.sum(axis=1)[:, None]).real
    values = values[np.argsort(-np.abs(values))]
    for r in run("q_spectral_gaps").itertuples():
        steps = values[:-1] ** r.power - values[1:] ** r.power
        assert math.isclose(r.gap, steps.max(), rel_tol=1e-6, abs_tol=1e-12)
    # three cliques, faintly tied
    w = np.kron(np.eye(3), np.ones((5, 5))) + 1e-3
    assert G.cluster_count(G.spectral_gaps(w)) == 3


def test_link_rank_communities(run, spark):
    from tessitura.operators import graphs as G
    from tessitura.plans.tables import nation_edges

    b, nodes = G.matrix_array(G.link_rank_modularity(nation_edges(spark, SF)))
    found = run("q_link_rank_communities").set_index("node")["community"]
    assert set(found.index) == set(nodes) and abs(b.sum()) < 1e-6
    label = found.loc[nodes].to_numpy()
    assert b[label[:, None] == label[None]].sum() >= -1e-9


def test_griffin_lim_nears_the_amplitudes(run, spark):
    wide = signal(spark, SF, True).toPandas().pivot(index="n", columns="signal_id", values="x")
    got = run("q_griffin_lim").pivot(index="n", columns="signal_id", values="x")
    for name in wide.columns:
        want, own = (np.abs(K.spectrogram(v[name].to_numpy(), 24.0, 4.0, 0.5)[2]) for v in (wide, got))
        assert np.linalg.norm(want - own) < 0.5 * np.linalg.norm(want)


def test_grouped_design_does_not_bleed(spark):
    from tessitura.operators import learn as M
    from tessitura.operators import samples as S

    rows = [("g", c, n, float(10 * n + k)) if n < 5 else ("h", c, n, float(10 * n + k)) for k, c in enumerate("ab") for n in range(9)]
    samples = spark.createDataFrame(rows, "part string, signal_id string, n int, x double")
    got = {(r["n"], r["column"]): r["value"] for r in S.toeplitz(samples, [0, 2, -1], True, "part").collect()}
    for n in range(9):
        lo, hi = (0, 4) if n < 5 else (5, 8)
        for k in range(2):
            for at, lag in enumerate((0, 2, -1)):
                m = n - lag
                assert got[n, 3 * k + at] == (10 * m + k if lo <= m <= hi else 0)
        assert got[n, 6] == 1
    target = spark.createDataFrame([(n, float(n)) for n in range(9)], "n int, y double")
    m = M.convolution_model(samples, target, [0, 2, -1], "part")
    x = np.array([[got[n, c] for c in range(7)] for n in range(9)])
    assert np.allclose(m.gram, x.T @ x) and np.allclose(m.xty, x.T @ np.arange(9.0))


def test_early_stopping_and_solver_hook():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(60, 8)), np.array([2.0, -1, 0, 0, 0, 0, 0, 0])
    y = x @ w + rng.normal(size=60) * 2

    def model(rows):
        return L.ConvolutionModel(x[rows].T @ x[rows], x[rows].T @ y[rows], y[rows] @ y[rows], len(rows))

    train, held = model(np.arange(40)), model(np.arange(40, 60))
    stopped = L.threshold_descent(train, np.zeros(8), 0.05, 0.0, 500, slope=1.0, held=held)
    assert held.error(stopped) <= held.error(np.zeros(8))
    calls = []
    L.in_crowd(train, 1.0, solver=lambda g, b: calls.append(len(b)) or K.elastic_net(g, b, 1.0, 0.0))
    assert calls


def test_pseudo_covariance(spark):
    from tessitura.operators import learn as M

    rng = np.random.default_rng(1)
    z = rng.normal(size=(50, 3)) + 1j * rng.normal(size=(50, 3))
    rows = spark.createDataFrame([(r.real.tolist(), r.imag.tolist()) for r in z], "re array<double>, im array<double>")
    cov, pseudo = M.complex_moments(rows, 3)
    parts = (z.real - z.real.mean(axis=0)) / z.real.std(axis=0, ddof=1) + 1j * (z.imag - z.imag.mean(axis=0)) / z.imag.std(axis=0, ddof=1)
    assert np.allclose(cov, parts.conj().T @ parts / 50) and np.allclose(pseudo, parts.T @ parts / 50)


def test_peaks_apart(run, spark):
    """Greedy thinning by the definition, on the rising-edge peaks of every signal."""
    got = run("q_peaks_distance")
    wide = signal(spark, SF, True).toPandas().pivot(index="n", columns="signal_id", values="x")
    for name in set(got["signal_id"]):
        x = wide[name].to_numpy()
        at = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i + 1] <= x[i] and x[i] >= 300]
        own = sorted(got[got["signal_id"] == name]["n"])
        assert set(own) <= set(at) and (np.diff(own) > 12).all()
        # whatever isn't kept has a kept peak, as high or higher, within reach
        for i in set(at) - set(own):
            assert any(abs(i - k) <= 12 and x[k] >= x[i] for k in own)

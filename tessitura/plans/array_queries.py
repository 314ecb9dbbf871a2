"""Queries whose kernels run in Arrow batches; their SQL twins, where SQL can say it, are in ``kernel_sql``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessitura.functions import kernels as K
from tessitura.functions import learn_kernels as L
from tessitura.operators import arrays as A
from tessitura.operators import graphs as G
from tessitura.operators import learn as M
from tessitura.operators import statistics as T
from tessitura.plans import kernel_sql
from tessitura.plans.kernel_sql import BANDS
from tessitura.plans.tables import nation_edges, r, signal, table
from tessitura.session import shared_folder, shared_table
from tessitura.sources import wav

QUERIES: dict = {}


def query(f):
    QUERIES[f"q_{f.__name__}"] = f
    return f


def _arrays(spark, d):
    return A.gather(signal(spark, d, True))


def _samples(arrays, digits: int):
    return A.spread(arrays).select("signal_id", "n", r("x", digits).alias("x"))


def _complex(rows, digits: int):
    return rows.select(*[r(c, digits).alias(c) if c in ("re", "im") else c for c in rows.columns])


@query
def lowpass(spark, d):
    return _samples(_arrays(spark, d).select("signal_id", A.lowpass("x", 24.0, 2.0).alias("x")), 4)


@query
def highpass(spark, d):
    return _samples(_arrays(spark, d).select("signal_id", A.highpass("x", 24.0, 2.0).alias("x")), 4)


@query
def bandpass(spark, d):
    return _samples(_arrays(spark, d).select("signal_id", A.bandpass("x", 24.0, 0.8, 1.2, 3).alias("x")), 4)


@query
def resample(spark, d):
    return _samples(_arrays(spark, d).select("signal_id", A.resample("x", 24.0, 12.0).alias("x")), 5)


@query
def envelope(spark, d):
    return _samples(_arrays(spark, d).select("signal_id", A.envelope("x", 24.0, 1.0).alias("x")), 4)


@query
def analytic_signal(spark, d):
    z = _arrays(spark, d).select("signal_id", F.posexplode(A.analytic("x")).alias("n", "z"))
    return _complex(z.select("signal_id", "n", "z.re", "z.im"), 5)


@query
def fft_segments(spark, d):
    z = _arrays(spark, d).select("signal_id", F.posexplode(A.fft("x")).alias("k", "z"))
    return _complex(z.select("signal_id", "k", "z.re", "z.im"), 3)


@query
def gaussian_stft(spark, d):
    rows = A.stft_rows(_arrays(spark, d), 24.0, 2.0, 0.5, K.GaussianEstimator())
    return _complex(rows.withColumns({"t": r("t"), "f": r("f")}), 5)


@query
def multitaper_stft(spark, d):
    return A.stft_rows(_arrays(spark, d), 24.0, 4.0, 1.0, K.MultitaperEstimator(0.75, adaptive=True))


@query
def multitaper_frames(spark, d):
    rows = A.stft_rows(_arrays(spark, d), 24.0, 4.0, 1.0, K.MultitaperEstimator(0.75))
    return rows.select("signal_id", "t_idx", "f_idx", r("re", 4).alias("power"))


@query
def wavelet_scalogram(spark, d):
    est = K.WaveletEstimator(6, 0.5, 8, 12)
    rows = A.stft_rows(_arrays(spark, d), 24.0, est.window(), 1.0, est)
    return _complex(rows.withColumns({"t": r("t"), "f": r("f")}), 4)


@query
def mean_spectrogram(spark, d):
    out = A.mean_spectrogram(_arrays(spark, d), 24.0, [2.0, 4.0], 1.0, 0.5, 10.0, 16, 3.0)
    return out.select("signal_id", "t_idx", "band", r("x", 5).alias("x"))


@query
def multitaper_coherence(spark, d):
    out = A.multitaper_coherence(signal(spark, d, True), 24.0, 120, 0.5, 3)
    return out.select("a", "b", "k", *[r(c).alias(c) for c in ("freq", "re", "im", "coherence", "lower", "upper")])


@query
def multitaper_power(spark, d):
    out = A.multitaper_power(signal(spark, d, True), 24.0, 120, 3)
    return out.select("signal_id", "k", r("freq").alias("freq"), r("power", 4).alias("power"), r("std", 4).alias("std"))


@query
def modulation_spectrum(spark, d):
    out = A.modulation_rows(_arrays(spark, d), 24.0, 4.0, 0.5)
    return out.select("signal_id", r("wf").alias("wf"), r("wt").alias("wt"), r("power", 4).alias("power"))


@query
def inverse_spectrogram(spark, d):
    def run(v):
        v = np.asarray(v)
        _, _, s = K.spectrogram(v, 24.0, 4.0, 0.5)
        return K.inverse_spectrogram(s, len(v), 24.0, 4.0, 0.5)

    return _samples(_arrays(spark, d).select("signal_id", A.array_map(run).alias("x")), 5)


@query
def surrogates(spark, d):
    return A.spread(_arrays(spark, d).select("signal_id", A.array_map(lambda v: K.surrogates(v, 3, 1).ravel()).alias("x")))


@query
def surrogate_power(spark, d):
    """|FFT|^2 of surrogates, which is that of the signal."""
    copies = A.surrogate_rows(_arrays(spark, d), 3, 1)
    power = A.array_map(lambda v: np.abs(np.fft.rfft(v)) ** 2 / 1e6)
    return copies.select("signal_id", "copy", F.posexplode(power).alias("k", "power")).select("signal_id", "copy", "k", r("power", 4).alias("power"))


@query
def band_analytic(spark, d):
    out = A.band_rows(_arrays(spark, d), 24.0, [c for c, _ in BANDS], [w for _, w in BANDS])
    return _complex(out, 5)


@query
def linear_prediction(spark, d):
    a = _arrays(spark, d).select("signal_id", A.array_map(lambda v: K.lpc(v, 2)).alias("a"))
    return a.select("signal_id", *[r(F.col("a")[i]).alias(f"a{i}") for i in range(3)])


@query
def split_half_coherence(spark, d):
    days = signal(spark, d, True).select(F.concat_ws("-", "signal_id", F.floor(F.col("n") / 240)).alias("trial"), (F.col("n") % 240).cast("int").alias("n"), "x")
    out = A.split_half_coherence(days, 24.0, 48, 2)
    return out.select("perm", "k", r("freq").alias("freq"), r("coherence").alias("coherence"))


def _cf(spark, d, a, b):
    return T.correlation_function(signal(spark, d, True), a, b, list(range(-24, 25)))


@query
def lag_coherency(spark, d):
    out = A.lag_coherency(_cf(spark, d, "click", "view"), _cf(spark, d, "click", "click"), _cf(spark, d, "view", "view"))
    return out.select("lag", r("coherency").alias("coherency"))


@query
def wiener_filter(spark, d):
    out = A.wiener_filter(_cf(spark, d, "click", "view"), _cf(spark, d, "click", "click"), _cf(spark, d, "view", "view"))
    return out.select("k", *[r(c).alias(c) for c in ("re", "im", "coherence")])


@query
def acf_spectrum(spark, d):
    return A.acf_spectrum(_cf(spark, d, "click", "click")).select("k", r("power").alias("power"))


@query
def whiten(spark, d):
    return M.whiten(signal(spark, d, True), 3).select("signal_id", "n", r("x", 5).alias("x"))


@query
def sound_features(spark, d):
    return A.sound_features(_arrays(spark, d), 1000.0, 450.0, lowest=60, highest=200)


@query
def empirical_modes(spark, d):
    return A.modes(_arrays(spark, d))


@query
def mode_sums(spark, d):
    """Modes and rest add up to the signal."""
    return A.modes(_arrays(spark, d)).groupBy("signal_id", "n").agg(r(F.sum("value"), 5).alias("x"))


@query
def multichannel_mode_sums(spark, d):
    return A.multi_modes(signal(spark, d, True), 3, 8).groupBy("signal_id", "n").agg(r(F.sum("value"), 5).alias("x"))


@query
def multichannel_modes(spark, d):
    return A.multi_modes(signal(spark, d, True), 3, 8)


def _strf(spark, d):
    samples = signal(spark, d, True)
    target = samples.filter("signal_id = 'click'").select("n", F.col("x").alias("y"))
    return samples.filter("signal_id <> 'click'"), target


def _weights(spark, w, bias):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(w) for j, v in enumerate(row)] + [(-1, -1, float(bias))], "channel int, lag int, w double")


@query
def strf_ridge(spark, d):
    return _weights(spark, *M.strf_ridge(*_strf(spark, d), [0, 1, 2], 10.0))


@query
def strf_lasso(spark, d):
    return _weights(spark, *M.strf_lasso(*_strf(spark, d), [0, 1, 2], 1e5, 1.0))


@query
def in_crowd(spark, d):
    w = L.in_crowd(M.convolution_model(*_strf(spark, d), [0, 1, 2]), 1e5)
    return _weights(spark, w[:-1].reshape(-1, 3), w[-1])


@query
def threshold_descent(spark, d):
    m = M.convolution_model(*_strf(spark, d), [0, 1, 2])
    w = L.threshold_descent(m, np.zeros(len(m.xty)), 1e-3, 0.5, 500)
    return _weights(spark, w[:-1].reshape(-1, 3), w[-1])


@query
def effective_dof(spark, d):
    m = M.convolution_model(*_strf(spark, d), [0, 1, 2])
    return spark.createDataFrame([(L.effective_dof(m.gram, 1e6),)], "dof double")


@query
def discriminate(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
    return M.discriminate(rows, 5).select("method", "truth", "predicted", r("p").alias("p"), "count")


@query
def discriminate_summary(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")
    return M.discriminate_summary(M.discriminate(rows, 5))


@query
def complex_pca(spark, d):
    wide = F.transform("embedding", lambda v: v.cast("double"))
    values, _ = M.complex_pca(table(spark, d, "embeddings").filter("embedding IS NOT NULL").select(F.slice(wide, 1, 32).alias("re"), F.slice(wide, 33, 32).alias("im")), 32)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, value double")


@query
def shuffle_test(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    return M.shuffle_test(rows, L.knn_mi, 50)


@query
def communities(spark, d):
    w, nodes = G.weight_array(shared_table(nation_edges(spark, d), "edges"))
    s = w.sum(axis=1)
    found = G.leaves(G.communities(w - np.outer(s, s) / s.sum()))
    return spark.createDataFrame([(int(nodes[i]), c) for c, m in enumerate(found) for i in m], "node long, community int")


@query
def link_rank_communities(spark, d):
    b, nodes = G.matrix_array(G.link_rank_modularity(shared_table(nation_edges(spark, d), "edges")))
    found = G.leaves(G.communities(b, directed=True))
    return spark.createDataFrame([(int(nodes[i]), c) for c, m in enumerate(found) for i in m], "node long, community int")


@query
def spectral_gaps(spark, d):
    w, _ = G.weight_array(shared_table(nation_edges(spark, d), "edges"))
    return spark.createDataFrame(G.spectral_gaps(w, range(1, 50)), "power int, place int, gap double")


@query
def spectral_clusters(spark, d):
    w, nodes = G.weight_array(shared_table(nation_edges(spark, d), "edges"))
    return spark.createDataFrame([(int(n), int(c)) for n, c in zip(nodes, G.spectral_clusters(w, 3), strict=True)], "node long, cluster int")


@query
def wav_round_trip(spark, d):
    """Signals written as WAV files to the shared folder, found and read back."""
    folder = shared_folder(spark, "wav")
    wav.write_wav(_arrays(spark, d), folder, 24)
    back = wav.read_wav(spark, folder)
    name = F.regexp_extract("signal_id", r"([^/]*)\.wav$", 1)
    sizes = F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    return back.select(name.alias("signal_id"), "sr", F.size("x").cast("long").alias("samples"), sizes.alias("peak"), F.aggregate("x", F.lit(0.0), lambda m, v: m + v).alias("total"))


ORACLES = {name: sql for name, sql in kernel_sql.ORACLES.items() if name in QUERIES}

"""Queries over whole sounds, receptive fields, point sets and streams, with their SQL where there is one."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessitura.functions import columns as C
from tessitura.functions import kernels as K
from tessitura.functions import learn_kernels as L
from tessitura.operators import arrays as A
from tessitura.operators import learn as M
from tessitura.operators import points as P
from tessitura.operators import sounds as U
from tessitura.operators import statistics as T
from tessitura.plans.kernel_sql import RECTIFIED, angle, rounded, stft, values_table, zero_phase
from tessitura.plans.point_queries import FS, HARMONIC, STRF, TRIALS, TS, _trials
from tessitura.plans.tables import HOURS, MULTI, r, seconds, signal, table
from tessitura.session import shared_folder
from tessitura.sources import generators as S
from tessitura.sources import wav
from tessitura.streaming import operators as W

QUERIES: dict = {}
ORACLES: dict = {}
TAU = 2 * math.pi


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _arrays(spark, d):
    return A.gather(signal(spark, d, True))


# --- analysis of a recording ----------------------------------------------------------------------------------------

LINES = f"""z AS (SELECT signal_id, k, sum(x * cos({angle('k * n', HOURS)})) AS re, sum(x * sin({angle('k * n', HOURS)})) AS im FROM sig CROSS JOIN range(1, {HOURS // 2}) f(k) GROUP BY 1, 2),
lines AS (SELECT signal_id, k, k * 24 / {HOURS}::DOUBLE AS freq, log10(sqrt(re * re + im * im)) AS power FROM z)"""
DB = f"{stft(45, 6, 45)}, db AS (SELECT signal_id, k, t_idx, greatest(20 * log10(greatest(sqrt(re * re + im * im), 1e-300) / max(sqrt(re * re + im * im)) OVER (PARTITION BY signal_id)) + 80, 0) AS value FROM tf)"


@query("q_line_spectrum", f"WITH {MULTI}, {LINES} SELECT signal_id, CAST(k AS INTEGER) AS k, {rounded('freq', 6)} AS freq, {rounded('power', 6)} AS power FROM lines")
def line_spectrum(spark, d):
    return U.line_spectrum(_arrays(spark, d), 24.0).select("signal_id", "k", r("freq").alias("freq"), r("power").alias("power"))


@query("q_log_spectrogram_rows", f"WITH {MULTI}, {DB} SELECT signal_id, CAST(k AS INTEGER) AS f_idx, CAST(t_idx AS INTEGER) AS t_idx, {rounded('value', 5)} AS value FROM db")
def log_spectrogram_rows(spark, d):
    return U.log_spectrogram_rows(_arrays(spark, d), 24.0, 4.0, 0.5).select("signal_id", "f_idx", "t_idx", r("value", 5).alias("value"))


@query(
    "q_analyze",
    f"""WITH {MULTI}, {LINES}, {DB}, f AS (SELECT signal_id, arg_max(freq, power) AS fundamental, max(power) AS peak, count(*) AS lines FROM lines GROUP BY 1), s AS (SELECT signal_id, count(*) AS cells, avg(value) AS level FROM db GROUP BY 1)
    SELECT signal_id, CAST({HOURS} AS INTEGER) AS samples, round(fundamental, 6) AS fundamental, round(peak, 6) AS peak, CAST(lines AS INTEGER) AS lines, CAST(cells AS INTEGER) AS cells, round(level, 5) AS level FROM f JOIN s USING (signal_id)""",
)
def analyze(spark, d):
    out = U.analyze(_arrays(spark, d), 24.0, spec_rate=4.0, spacing=0.5, cut=1.0)
    peak = F.array_max(F.transform("power", lambda p: p["power"]))
    level = F.aggregate("spectrogram", F.lit(0.0), lambda m, v: m + v["value"]) / F.size("spectrogram")
    return out.select("signal_id", F.size("envelope").alias("samples"), r("fundamental").alias("fundamental"), r(peak).alias("peak"), F.size("power").alias("lines"), F.size("spectrogram").alias("cells"), r(level, 5).alias("level"))


@query(
    "q_welch",
    f"""WITH {MULTI}, w AS (SELECT m, 0.5 - 0.5 * cos({TAU!r} * m / 255) AS w FROM range(256) g(m)), f AS (SELECT signal_id, p, m, x * w AS v FROM range(4) g(p) CROSS JOIN w JOIN sig ON n = p * 128 + m),
    z AS (SELECT signal_id, p, k, sum(v * cos({angle('k * m', 256)})) AS re, sum(v * sin({angle('k * m', 256)})) AS im FROM f CROSS JOIN range(129) h(k) GROUP BY 1, 2, 3)
    SELECT signal_id, CAST(k AS INTEGER) AS k, {rounded('k * 24 / 256::DOUBLE', 6)} AS freq, {rounded('avg(re * re + im * im) / (24 * (SELECT sum(w * w) FROM w)) * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END', 4)} AS density FROM z GROUP BY signal_id, k""",
)
def welch(spark, d):
    def run(x):
        f, p = K.welch(x, 24.0, 256, 128)
        return {"k": np.arange(len(f)), "freq": f, "density": p}

    return A.rows_of(_arrays(spark, d), run, "k int, freq double, density double").select("signal_id", "k", r("freq").alias("freq"), r("density", 4).alias("density"))


@query("q_comb_residual", f"WITH g AS (SELECT CAST(i AS INTEGER) AS i, i * 20::DOUBLE AS f FROM range(200) r(i)), m AS (SELECT i, f, 0.9::DOUBLE * exp(-((f - 440) ** 2) / 7200) + 0.5::DOUBLE * exp(-((f - 880) ** 2) / 7200) + 0.25::DOUBLE * exp(-((f - 1320) ** 2) / 7200) AS m FROM g) SELECT f AS freq, {rounded('m', 8)} AS model, {rounded('1 / (1 + f / 1000) - m', 8)} AS residual FROM m")
def comb_residual(spark, d):
    spectra = spark.range(200).select(F.lit("s").alias("signal_id"), (F.col("id") * 20.0).alias("freq")).withColumn("value", 1 / (1 + F.col("freq") / 1000))
    return U.comb_residual(spectra, [440.0, 0.9, 0.5, 0.25]).select("freq", r("model", 8).alias("model"), r("residual", 8).alias("residual"))


def _stacks(spark):
    """Harmonic stacks of known pitch, a quarter of a second at 10 kHz."""
    parts = [S.simple_stack(spark, 0.25, f, 10000.0, 8).select(F.lit(str(int(f))).alias("signal_id"), "n", "x") for f in (400.0, 450.0, 550.0)]
    return A.gather(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("q_pitch_methods", "SELECT s AS signal_id, m AS method, CAST(s AS DOUBLE) AS pitch FROM (VALUES ('400'), ('450'), ('550')) a(s) CROSS JOIN (VALUES ('AC'), ('ACA'), ('Cep'), ('HPS'), ('Stack')) b(m)")
def pitch_methods(spark, d):
    """Median pitch of stacks by every method, to the nearest 50 Hz."""
    out = None
    for method in ("AC", "ACA", "Cep", "HPS", "Stack"):
        own = U.pitch_tracks(_stacks(spark), 10000.0, method, 300, 1500, hop=0.02).filter(~F.isnan("f0"))
        own = own.groupBy("signal_id").agg(F.percentile("f0", F.lit(0.5)).alias("pitch")).select("signal_id", F.lit(method).alias("method"), (F.round(F.col("pitch") / 50) * 50).alias("pitch"))
        out = own if out is None else out.unionByName(own)
    return out


@query("q_formants")
def formants(spark, d):
    return U.formant_tracks(_stacks(spark), 10000.0, hop=0.05)


@query(
    "q_amplitude_moments",
    f"""WITH RECURSIVE {MULTI}, {RECTIFIED}, {zero_phase(K.butter_sos(4, 2 * 1.0 / 24, 'low'), 'rectified')}, a AS (SELECT signal_id, n / 24::DOUBLE AS t, greatest(x, 0) AS a FROM filtered),
    p AS (SELECT *, a / sum(a) OVER (PARTITION BY signal_id) AS p FROM a), m AS (SELECT *, sum(p * t) OVER (PARTITION BY signal_id) AS mean FROM p),
    s AS (SELECT signal_id, max(a) AS top, max(mean) AS mean, sqrt(sum(p * (t - mean) ** 2)) AS sd, sum(p * (t - mean) ** 3) AS m3, sum(p * (t - mean) ** 4) AS m4, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(count(*) FILTER (p > 0)) AS h FROM m GROUP BY 1)
    SELECT signal_id, round(top, 5) AS max_amp, round(mean, 6) AS mean, round(sd, 6) AS std, round(m3 / sd ** 3, 6) + 0.0 AS skew, round(m4 / sd ** 4, 6) AS kurtosis, round(h, 6) AS entropy FROM s""",
)
def amplitude_moments(spark, d):
    out = U.amplitude_moments(_arrays(spark, d), 24.0, 1.0, None)
    return out.select("signal_id", r("max_amp", 5).alias("max_amp"), *[r(c).alias(c) for c in ("mean", "std", "skew", "kurtosis", "entropy")])


def _band(number: int, sos) -> str:
    return f"SELECT {number} AS band, signal_id, n, x FROM (WITH RECURSIVE {MULTI}, {zero_phase(sos)} SELECT signal_id, n, x FROM filtered)"


@query(
    "q_bandpass_analytic",
    f"""WITH b AS ({_band(0, K.butter_sos(5, 2 * 0.8 / 24, 'low'))} UNION ALL {_band(1, K.butter_sos(5, (2 * 0.8 / 24, 2 * 2.0 / 24), 'band'))})
    SELECT a.signal_id, CAST(a.band AS INTEGER) AS band, a.n, {rounded('max(a.x)', 4)} AS re, {rounded(f'sum(b.x * 2 / {HOURS} / tan(pi() * (a.n - b.n) / {HOURS}))', 4)} AS im FROM b a JOIN b ON b.signal_id = a.signal_id AND b.band = a.band AND (a.n + b.n) % 2 = 1 GROUP BY 1, 2, 3""",
)
def bandpass_analytic(spark, d):
    out = A.bandpass_rows(_arrays(spark, d), 24.0, [0.8, 2.0])
    return out.select("signal_id", "band", "n", r("re", 4).alias("re"), r("im", 4).alias("im"))


@query("q_frame_loudness", f"WITH {MULTI}, {stft(49, 12, 50)} SELECT signal_id, CAST(t_idx AS BIGINT) AS t_idx, {rounded('sum(sqrt(re * re + im * im))', 4)} AS rms FROM tf GROUP BY 1, 2")
def frame_loudness(spark, d):
    out = A.frame_loudness(A.stft_rows(_arrays(spark, d), 24.0, 2.0, 0.5, K.GaussianEstimator()))
    return out.select("signal_id", "t_idx", r("rms", 4).alias("rms"))


@query(
    "q_multitaper_jackknife",
    f"""WITH {MULTI}, {values_table("w", "taper, j, w", [(i, j, v) for i, row in enumerate(K.dpss(97, 3, 5)[0]) for j, v in enumerate(row)])},
    z AS (SELECT s.signal_id, t, taper, k, sum(x * w * cos({angle('k * j', 97)})) AS re, sum(x * w * sin({angle('k * j', 97)})) AS im FROM range(30) r(t) CROSS JOIN w JOIN sig s ON s.n = t * 24 + j - 48 CROSS JOIN range(49) h(k) GROUP BY 1, 2, 3, 4)
    SELECT signal_id, CAST(t AS INTEGER) AS t_idx, CAST(k AS INTEGER) AS f_idx, {rounded('avg(re * re + im * im)', 4)} AS power, {rounded('stddev_samp(re * re + im * im) / sqrt(5)', 4)} AS sd FROM z GROUP BY 1, 2, 3""",
)
def multitaper_jackknife(spark, d):
    out = A.multitaper_jackknife(_arrays(spark, d), 24.0, 4.0, 1.0, 0.75)
    return out.select("signal_id", "t_idx", "f_idx", r("power", 4).alias("power"), r("sd", 4).alias("sd"))


# --- modulation and grids -------------------------------------------------------------------------------------------

CELLS = f"{STRF}, v AS (SELECT i, j, sin({TAU} * 10 * (t - 0.15::DOUBLE)) * exp(-((f - 3000) ** 2) / 500000) * exp(-((t - 0.15::DOUBLE) ** 2) / 0.125::DOUBLE) AS w FROM g), s AS (SELECT i, j, w / max(abs(w)) OVER () AS w FROM v)"


def _field(spark):
    """An onset field as a spectrogram: 31 times, 21 frequencies."""
    return S.onset_strf(spark, TS, FS).select(F.lit("strf").alias("signal_id"), F.col("j").alias("f_idx"), F.col("i").alias("t_idx"), F.col("w").alias("value"))


def _mtfft(column: str, where: str) -> str:
    turn = f"({angle('kf * j', 21)} + {angle('kt * ' + column, 31)})"
    return f"""z AS (SELECT kf, kt, sum(w * cos({turn})) AS re, -sum(w * sin({turn})) AS im FROM s CROSS JOIN range(21) a(kf) CROSS JOIN range(31) b(kt) GROUP BY 1, 2)
    SELECT {rounded('CASE WHEN kf > 10 THEN kf - 21 ELSE kf END / 21::DOUBLE / 300 * 1000', 6)} AS wf, {rounded('CASE WHEN kt > 15 THEN kt - 31 ELSE kt END / 31::DOUBLE / 0.01::DOUBLE', 6)} AS wt, {rounded('re * re + im * im', 6)} AS power FROM z {where}"""


@query("q_mtfft", f"WITH {CELLS}, {_mtfft('i', '')}")
def mtfft(spark, d):
    return U.modulation_power(_field(spark), 300.0, 0.01).select(r(F.col("wf") * 1000).alias("wf"), r("wt").alias("wt"), r("power").alias("power"))


@query("q_strf_mps", f"WITH {CELLS}, {_mtfft('(30 - i)', 'WHERE kf <= 10')}")
def strf_mps(spark, d):
    out = U.modulation_power(_field(spark), 300.0, 0.01, True, True)
    return out.select(r(F.col("wf") * 1000).alias("wf"), r("wt").alias("wt"), r("power").alias("power"))


@query("q_mps_round_trip", f"WITH {MULTI}, {DB} SELECT signal_id, CAST(k AS INTEGER) AS f_idx, CAST(t_idx AS INTEGER) AS t_idx, {rounded('value', 5)} AS value FROM db")
def mps_round_trip(spark, d):
    """Log spectrograms through their modulation spectrum and back."""
    back = U.filter_modulation(U.log_spectrogram_rows(_arrays(spark, d), 24.0, 4.0, 0.5), 24 / 45, 0.25)
    return back.select("signal_id", "f_idx", "t_idx", r("value", 5).alias("value"))


@query("q_regrid", f"WITH {CELLS} SELECT CAST(j AS INTEGER) AS f_idx, CAST(i AS INTEGER) AS t_idx, {rounded('w', 6)} AS value FROM s")
def regrid(spark, d):
    """A field on a grid twice as fine, at the places of the first grid."""
    fine = U.regrid(_field(spark), 300.0, 0.01, 150.0, 0.005).filter("f_idx % 2 = 0 AND t_idx % 2 = 0")
    return fine.select((F.col("f_idx") / 2).cast("int").alias("f_idx"), (F.col("t_idx") / 2).cast("int").alias("t_idx"), r("value").alias("value"))


@query("q_reassign", f"WITH {CELLS} SELECT round(sum(w), 6) + 0.0 AS total, CAST(651 AS BIGINT) AS cells FROM s")
def reassign(spark, d):
    """Reassignment moves what bins hold and loses nothing."""
    return U.reassign(_field(spark), 300.0, 0.01).agg(r(F.sum("value")).alias("total"), F.count("*").alias("cells"))


@query("q_griffin_lim")
def griffin_lim(spark, d):
    def run(x):
        _, f, s = K.spectrogram(x, 24.0, 4.0, 0.5, cmplx=False)
        return U._grid(s, f_idx=np.arange(len(f)), t_idx=np.arange(s.shape[1]))

    amplitudes = A.rows_of(_arrays(spark, d), run, "f_idx int, t_idx int, value double")
    return U.griffin_lim(amplitudes, HOURS, 24.0, 4.0, 0.5, 5)


# --- modes, phases, components --------------------------------------------------------------------------------------


@query("q_ensemble_modes")
def ensemble_modes(spark, d):
    return U.ensemble_modes(_arrays(spark, d), 5, 0.1, 1)


@query("q_normalized_hilbert", f"SELECT CAST(n AS INTEGER) AS n, {rounded(f'sin({TAU!r} * 5 * (n / 1000::DOUBLE))', 4)} AS x FROM range(1000) r(n)")
def normalized_hilbert(spark, d):
    """Amplitude times the cosine of the phase is the signal."""
    wave = A.gather(S.sine_wave(spark, 1.0, 5.0, 1000.0).select(F.lit("s").alias("signal_id"), "n", "x"))
    return U.normalized_hilbert(wave, 1000.0).select("n", r(F.col("amp") * F.cos("phase"), 4).alias("x"))


@query(
    "q_demodulate",
    f"""WITH {MULTI}, z AS (SELECT a.signal_id, a.n, max(a.x) AS re, sum(b.x * 2 / {HOURS} / tan(pi() * (a.n - b.n) / {HOURS})) AS im FROM sig a JOIN sig b ON b.signal_id = a.signal_id AND (a.n + b.n) % 2 = 1 GROUP BY 1, 2)
    SELECT signal_id, n, {rounded('sqrt(re * re + im * im)', 5)} AS size FROM z""",
)
def demodulate(spark, d):
    """Demodulation turns phases and keeps sizes."""
    z = _arrays(spark, d).select("signal_id", F.posexplode(A.analytic("x")).alias("n", "z")).select("signal_id", "n", "z.re", "z.im")
    return U.demodulate(z).select("signal_id", "n", r(F.hypot("re", "im"), 5).alias("size"))


@query("q_complex_round_trip", "SELECT vec_id AS id, CAST(c AS INTEGER) AS c, round(CAST(embedding[c + 1] AS DOUBLE), 6) + 0.0 AS re, round(CAST(embedding[c + 33] AS DOUBLE), 6) + 0.0 AS im FROM embeddings CROSS JOIN range(32) r(c) WHERE embedding IS NOT NULL")
def complex_round_trip(spark, d):
    """Complex vectors through all their components and back."""
    wide = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), F.slice(wide, 1, 32).alias("re"), F.slice(wide, 33, 32).alias("im"))
    _, vectors = M.complex_pca(rows, 32)
    back = M.complex_inverse(M.complex_transform(rows, vectors), vectors)
    out = back.select("id", F.posexplode(F.arrays_zip("re", "im")).alias("c", "z"))
    return out.select("id", "c", r("z.re").alias("re"), r("z.im").alias("im"))


# --- statistics -----------------------------------------------------------------------------------------------------

CUTS = ", ".join(f"quantile_cont(l_extendedprice, {int(k * 100 / 11) / 100})" for k in range(1, 10))


@query(
    "q_binned_mean_quantile",
    f"""WITH e AS (SELECT list_concat([min(l_extendedprice)::DOUBLE], [{CUTS}], [max(l_extendedprice)::DOUBLE]) AS edges FROM lineitem),
    p AS (SELECT len(list_filter(edges, lambda x: x <= l_extendedprice)) - 1 AS bin, edges, l_quantity AS y FROM lineitem, e WHERE l_extendedprice < edges[11])
    SELECT CAST(bin AS INTEGER) AS bin, round(max(edges[bin + 1]) / 2 + max(edges[bin + 2]) / 2, 7) AS center, round(avg(y), 6) AS mean, round(stddev_samp(y) / sqrt(count(*)), 6) AS se, count(*) AS count FROM p GROUP BY bin""",
)
def binned_mean_quantile(spark, d):
    out = T.binned_mean(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 10, True)
    return out.select("bin", r("center", 7).alias("center"), r("mean").alias("mean"), r("se").alias("se"), "count")


@query("q_smooth_bins")
def smooth_bins(spark, d):
    return T.smooth_bins(T.binned_mean(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 10, True), 50)


COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("q_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) + 0.0 AS r FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i:]))
def correlation_matrix(spark, d):
    return T.correlation_matrix(table(spark, d, "lineitem"), list(COLS)).select("a", "b", r("r", 8).alias("r"))


@query(
    "q_discrete_information",
    f"""WITH {HARMONIC}, v AS (SELECT c_acctbal AS x, c_mktsegment AS y FROM customer WHERE c_acctbal IS NOT NULL),
    nn AS (SELECT y, {{near}} AS own FROM v WINDOW w AS (PARTITION BY y ORDER BY x)), al AS (SELECT {{near}} AS own FROM v WINDOW w AS (ORDER BY x)),
    h AS (SELECT y, count(*) AS n, avg(ln(own)) FILTER (own > 0) AS m FROM nn GROUP BY 1), a AS (SELECT count(*) AS n, avg(ln(own)) FILTER (own > 0) AS m FROM al),
    e AS (SELECT h.n, (p.psi - (SELECT psi FROM psi WHERE psi.n = 3) + ln(2) + m) / ln(2) AS e FROM h JOIN psi p ON p.n = h.n), w AS (SELECT (p.psi - (SELECT psi FROM psi WHERE psi.n = 3) + ln(2) + m) / ln(2) AS e FROM a JOIN psi p ON p.n = a.n)
    SELECT round((SELECT e FROM w) - sum(n * CASE WHEN n > 3 THEN e ELSE (SELECT e FROM w) END) / sum(n), 6) + 0.0 AS information FROM e""".replace(
        "{near}", "list_sort([v FOR v IN [x - lag(x, 1) OVER w, x - lag(x, 2) OVER w, x - lag(x, 3) OVER w, lead(x, 1) OVER w - x, lead(x, 2) OVER w - x, lead(x, 3) OVER w - x] IF v IS NOT NULL])[3]"
    ),
)
def discrete_information(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("y"))
    return M.discrete_information(rows).select(r("information").alias("information"))


@query(
    "q_spike_envelope_smooth",
    f"""WITH {TRIALS}, c AS (SELECT CAST(least(floor(t / 900), 95) AS INTEGER) AS bin, count(DISTINCT train_id) AS c FROM tr GROUP BY 1), m AS (SELECT bin, c FROM c UNION ALL SELECT -1 - bin, c FROM c UNION ALL SELECT 191 - bin, c FROM c),
    s AS (SELECT bin + o AS bin, sum(c * exp(-(((o + 15) * 100::DOUBLE / 29 - 50) ** 2) / 9)) AS c FROM m CROSS JOIN range(-15, 15) k(o) GROUP BY 1), f AS (SELECT CAST(g.b AS INTEGER) AS bin, coalesce(c, 0) AS c FROM range(96) g(b) LEFT JOIN s ON s.bin = g.b),
    q AS (SELECT max(c) AS top, quantile_cont(c, 0.25) AS cut FROM f) SELECT bin, round(CASE WHEN c < cut THEN 0 ELSE c / top END, 6) + 0.0 AS env FROM f, q""",
)
def spike_envelope_smooth(spark, d):
    return P.spike_envelope(_trials(spark, d), 0.0, 86400.0, 900.0, smooth=True, thresh_percentile=25).select("bin", r("env").alias("env"))


@query("q_cubic_spline_percentiles", "WITH k AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem) SELECT DISTINCT l_quantity AS x, round(power(greatest(l_quantity - a, 0), 3), 4) AS k1, round(power(greatest(l_quantity - b, 0), 3), 4) AS k2, round(power(greatest(l_quantity - c, 0), 3), 4) AS k3 FROM lineitem, k")
def cubic_spline_percentiles(spark, d):
    lines = table(spark, d, "lineitem")
    terms = C.cubic_terms(F.col("l_quantity"), T.percentile_knots(lines, "l_quantity", 3))
    return lines.select(F.col("l_quantity").alias("x"), *[r(t, 4).alias(f"k{i}") for i, t in enumerate(terms[3:], 1)]).distinct()


@query("q_radial_fit")
def radial_fit(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    fit = M.radial_fit(lines, "x", "y")
    return spark.createDataFrame([(i, float(c), float(b), float(w)) for i, (c, b, w) in enumerate(zip(fit["centers"], fit["widths"], fit["weights"], strict=True))], "i int, center double, width double, weight double")


#: Initial m of the first four dimensions of Sobol's sequence, each to seven bits, by hand from their recurrences.
M_SOBOL = ((1, 1, 1, 1, 1, 1, 1), (1, 3, 5, 15, 17, 51, 85), (1, 3, 3, 9, 29, 23, 71), (1, 3, 1, 5, 31, 29, 81))


@query(
    "q_quasirandom",
    f"""WITH v(dim, b, m) AS (VALUES {", ".join(f"({dim}, {b}, {m})" for dim, row in enumerate(M_SOBOL) for b, m in enumerate(row))}), g AS (SELECT i, xor(i + 1, (i + 1) // 2) AS gray FROM range(100) r(i))
    SELECT i, CAST(dim AS INTEGER) AS dim, round(coalesce(bit_xor(CASE WHEN (gray >> b) & 1 = 1 THEN m << (29 - b) ELSE 0 END), 0) / 1073741824::DOUBLE, 9) AS value FROM g CROSS JOIN v GROUP BY 1, 2""",
)
def quasirandom(spark, d):
    return S.quasirandom(spark, 4, 100).select("i", "dim", r("value", 9).alias("value"))


@query("q_sign_constrained")
def sign_constrained(spark, d):
    samples = signal(spark, d, True)
    m = M.convolution_model(samples.filter("signal_id <> 'click'"), samples.filter("signal_id = 'click'").select("n", F.col("x").alias("y")), [0, 1, 2])
    w = L.sign_constrained(m.gram, m.xty, np.where(np.arange(len(m.xty)) % 2, -1.0, 1.0), 200.0)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i int, w double")


@query("q_knn_measures")
def knn_measures(spark, d):
    """Entropy, mutual information, its conditional form and divergence in several dimensions."""
    rows = table(spark, d, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.col("s_suppkey").cast("double").alias("z"))
    return M.knn_measures(rows, ["x"], ["y"], ["z"])


# --- sources and streams --------------------------------------------------------------------------------------------


@query("q_sound_files", f"WITH {MULTI} SELECT DISTINCT signal_id || '.wav' AS name, CAST(44 + 2 * {HOURS} AS BIGINT) AS length FROM sig")
def sound_files(spark, d):
    """Files under a folder, by name and size, without their contents."""
    folder = shared_folder(spark, "wav")
    wav.write_wav(_arrays(spark, d), folder, 24)
    return wav.find_files(spark, folder, "*.wav").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")


@query("q_to_mono", f"WITH {MULTI} SELECT n, {rounded('avg(x)', 6)} AS x FROM sig GROUP BY 1")
def to_mono(spark, d):
    """The event types as channels of one sound, mixed."""
    channels = _arrays(spark, d).select(F.lit("all").alias("signal_id"), F.lit(24.0).alias("sr"), F.col("signal_id").alias("channel"), "x")
    return wav.to_mono(channels).select(F.posexplode("x").alias("n", "x")).select("n", r("x").alias("x"))


@query("q_sound_store", f"WITH {MULTI} SELECT signal_id, CAST(count(*) AS INTEGER) AS samples, round(max(abs(x)), 6) AS top FROM sig GROUP BY 1")
def sound_store(spark, d):
    """Records saved by partition and read back."""
    folder = shared_folder(spark, "sounds")
    records = _arrays(spark, d).select("signal_id", F.size("x").alias("samples"), F.array_max(F.transform("x", lambda v: F.abs(v))).alias("top"))
    wav.save_sounds(records, folder, "signal_id")
    return wav.read_sounds(spark, folder).select(F.col("signal_id").cast("string").alias("signal_id"), "samples", r("top").alias("top"))


def _events(spark, d):
    batch = table(spark, d, "events")
    # a pattern, as a stream's plain path must be a folder
    rows = spark.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]")
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", seconds().alias("s"))


def _drained(stream, mode: str = "complete"):
    """What a stream holds when all its input is read: the last complete table, or all updates."""
    spark = stream.sparkSession
    path, checkpoint = shared_folder(spark, "stream"), shared_folder(spark, "checkpoint")
    running = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    running.foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _window_sql(size: int, slide: int) -> str:
    """Counts and sums of windows of ``size`` seconds every ``slide``, by event type."""
    return f"""WITH ev AS (SELECT event_type, value, epoch_us(ts) / 1e6 AS s FROM events), w AS (SELECT event_type, value, CAST(floor(s / {slide}) - k AS BIGINT) * {slide} AS start FROM ev CROSS JOIN range({size // slide}) g(k))
    SELECT start, event_type, count(*) AS count, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"""


@query("q_stream_tumbling", _window_sql(21600, 21600))
def stream_tumbling(spark, d):
    out = _drained(W.windowed_rate(_events(spark, d), "6 hours"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "count", r("total", 4).alias("total"))


@query("q_stream_hopping", _window_sql(21600, 7200))
def stream_hopping(spark, d):
    out = _drained(W.windowed_rate(_events(spark, d), "6 hours", "2 hours"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "count", r("total", 4).alias("total"))


@query(
    "q_stream_sessions",
    """WITH ev AS (SELECT event_type, value, epoch_us(ts) AS s FROM events WHERE value > 50), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY event_type ORDER BY s) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM ev),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT event_type, min(s) AS start_us, max(s) + 1800000000 AS end_us, round(max(value), 6) AS peak FROM n GROUP BY event_type, session""",
)
def stream_sessions(spark, d):
    out = _drained(W.event_sessions(_events(spark, d), 50.0, "30 minutes"))
    return out.select("event_type", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), r("peak").alias("peak"))


@query("q_stream_moments", "SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance FROM events GROUP BY 1")
def stream_moments(spark, d):
    out = _drained(W.running_moments(_events(spark, d), "event_type", "value"))
    return out.select("event_type", "count", r("mean").alias("mean"), r("variance", 5).alias("variance"))


@query(
    "q_stream_forgetting",
    f"""WITH {MULTI}, o AS (SELECT signal_id, n, CASE WHEN x > 0 THEN 2 ELSE 1 END AS obs FROM sig), d AS (SELECT signal_id, obs, sum(power(1 - 1 / (1 * 12::DOUBLE), {HOURS - 1} - n)) AS s FROM o GROUP BY 1, 2),
    g AS (SELECT DISTINCT signal_id, CAST(k AS INTEGER) AS state FROM sig CROSS JOIN range(1, 3) r(k)),
    z AS (SELECT g.signal_id, g.state, coalesce(d.s, 0) + 0.1::DOUBLE AS s FROM g LEFT JOIN d ON d.signal_id = g.signal_id AND d.obs = g.state)
    SELECT signal_id, state, round(s / sum(s) OVER (PARTITION BY signal_id), 6) AS p FROM z""",
)
def stream_forgetting(spark, d):
    """Keyed state after the last tick of a stream of observations."""
    folder = shared_folder(spark, "observations")
    signal(spark, d, True).select("signal_id", F.col("n").cast("long").alias("n"), F.when(F.col("x") > 0, 2).otherwise(1).alias("obs")).write.parquet(folder)
    stream = spark.readStream.schema("signal_id string, n long, obs int").parquet(folder)
    last = _drained(W.forgetting_stream(stream, 2, 1.0, 12.0), "update").groupBy("signal_id").agg(F.max_by("p", "n").alias("p"))
    return last.select("signal_id", F.posexplode("p").alias("i", "p")).select("signal_id", (F.col("i") + 1).alias("state"), r("p").alias("p"))

"""Kernels as columns: signals gathered to arrays, mapped in Arrow batches, and spread to rows again.

One signal is one row, so signals run in parallel and the memory of a task is bounded by its longest signal; a signal that is
too long for a task must be framed first (tessitura.operators.samples.chunk).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import emd_kernels as E
from tessitura.functions import kernels as K
from tessitura.functions import sound_kernels as V
from tessitura.operators.samples import KEY, chunk, gather, rows_of

COMPLEX = "array<struct<re:double,im:double>>"


def spread(arrays: DataFrame, column: str = "x", *keys: str) -> DataFrame:
    """(keys, n, x): arrays back to samples."""
    keys = keys or (KEY,)
    return arrays.select(*keys, F.posexplode(column).alias("n", "x"))


def array_map(kernel: Callable[[np.ndarray], np.ndarray], column: str | Column = "x") -> Column:
    """A kernel from array to array, as a column."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(kernel(np.asarray(v, float)), float))

    return run(column)


def complex_map(kernel: Callable[[np.ndarray], np.ndarray], column: str | Column = "x") -> Column:
    """A kernel from array to complex array, as a column of (re, im)."""

    @F.pandas_udf(COMPLEX)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{"re": float(z.real), "im": float(z.imag)} for z in kernel(np.asarray(v, float))])

    return run(column)


def lowpass(column, rate: float, cut: float, order: int = 5, rescale: bool = False) -> Column:
    return array_map(lambda x: K.lowpass(x, rate, cut, order, rescale), column)


def highpass(column, rate: float, cut: float, order: int = 5, rescale: bool = False) -> Column:
    return array_map(lambda x: K.highpass(x, rate, cut, order, rescale), column)


def bandpass(column, rate: float, low: float, high: float, order: int = 5, rescale: bool = False) -> Column:
    return array_map(lambda x: K.bandpass(x, rate, low, high, order, rescale), column)


def resample(column, rate: float, wanted: float) -> Column:
    return array_map(lambda x: K.resample(x, int(len(x) / rate * wanted)), column)


def envelope(column, rate: float, cut: float = 200.0, resample_rate: float | None = None) -> Column:
    return array_map(lambda x: K.envelope(x, rate, cut, resample_rate), column)


def analytic(column, standard: bool = True) -> Column:
    return complex_map(lambda x: K.analytic(x, standard), column)


def fft(column) -> Column:
    return complex_map(np.fft.fft, column)


def stft_rows(arrays: DataFrame, rate: float, window: float, hop: float, estimator, low: float = 0, high: float | None = None, key: str = KEY) -> DataFrame:
    """(key, t_idx, f_idx, t, f, re, im) of every signal, by any estimator of tessitura.functions.kernels (the strategy hook)."""

    def run(batches):
        for rows in batches:
            for name, x in zip(rows[key], rows["x"], strict=True):
                t, f, tf = K.stft(np.asarray(x, float), rate, window, hop, estimator, low, high)
                fi, ti = np.meshgrid(np.arange(len(f)), np.arange(len(t)), indexing="ij")
                yield pd.DataFrame({key: name, "t_idx": ti.ravel(), "f_idx": fi.ravel(), "t": t[ti.ravel()], "f": f[fi.ravel()], "re": np.real(tf).ravel(), "im": np.imag(tf).ravel()})

    return arrays.select(key, "x").mapInPandas(run, f"{key} string, t_idx long, f_idx long, t double, f double, re double, im double")


def modulation_rows(arrays: DataFrame, rate: float, spec_rate: float, spacing: float, window: float | None = None) -> DataFrame:
    """(signal_id, wf, wt, power): modulation spectrum of the log spectrogram of every signal."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        _, f, s = K.spectrogram(x, rate, spec_rate, spacing)
        wf, wt, power = K.modulation_spectrum(20 * np.log10(np.abs(s) + 1e-9), f[1] - f[0], 1 / spec_rate, window)
        return {"wf": np.repeat(wf, len(wt)), "wt": np.tile(wt, len(wf)), "power": power.ravel()}

    return rows_of(arrays, run, "wf double, wt double, power double")


def bandpass_rows(arrays: DataFrame, rate: float, edges: list[float], order: int = 5) -> DataFrame:
    """(signal_id, band, n, re, im): analytic signals of a Butterworth low-pass under the first edge and band-passes above."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        z = K.bandpass_analytic(x, rate, edges, order)
        return {"band": np.repeat(np.arange(len(z)), len(x)), "n": np.tile(np.arange(len(x)), len(z)), "re": z.real.ravel(), "im": z.imag.ravel()}

    return rows_of(arrays, run, "band int, n int, re double, im double")


def frame_loudness(stft: DataFrame) -> DataFrame:
    """(signal_id, t_idx, rms): summed size of every time slice of ``stft_rows``."""
    return stft.groupBy(KEY, "t_idx").agg(F.sum(F.hypot("re", "im")).alias("rms"))


def multitaper_jackknife(arrays: DataFrame, rate: float, window: float, hop: float, bandwidth: float) -> DataFrame:
    """(signal_id, t_idx, f_idx, power, sd): mean power over the tapers of every frame, and its deviation by leaving tapers out."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        rows = K.frames(x, rate, window, hop)
        power, sd = K.MultitaperEstimator(bandwidth).jackknife(rows, rate)
        t, f = np.indices(power.shape)
        return {"t_idx": t.ravel(), "f_idx": f.ravel(), "power": power.ravel(), "sd": sd.ravel()}

    return rows_of(arrays, run, "t_idx int, f_idx int, power double, sd double")


def surrogate_rows(arrays: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(signal_id, copy, x): signals with the same power spectrum and shuffled phases."""
    return rows_of(arrays, lambda x: {"copy": np.arange(count), "x": list(K.surrogates(x, count, seed))}, "copy int, x array<double>")


def band_rows(arrays: DataFrame, rate: float, centers: list[float], widths: list[float]) -> DataFrame:
    """(signal_id, band, n, re, im): analytic signals of Gaussian bands in frequency."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        z = K.band_analytic(x, rate, centers, widths)
        return {"band": np.repeat(np.arange(len(z)), len(x)), "n": np.tile(np.arange(len(x)), len(z)), "re": z.real.ravel(), "im": z.imag.ravel()}

    return rows_of(arrays, run, "band int, n int, re double, im double")


def mean_spectrogram(arrays: DataFrame, rate: float, windows: list[float], hop: float, low: float, high: float, bands: int = 32, mask_gain: float | None = None) -> DataFrame:
    """(signal_id, t_idx, band, x): mean over window lengths of log spectrograms on one grid; optionally masked where they disagree."""
    grid = np.linspace(low, high, bands)

    def run(batches):
        for rows in batches:
            for name, x in zip(rows[KEY], rows["x"], strict=True):
                for w in windows:
                    t, f, tf = K.stft(np.asarray(x, float), rate, w, hop, K.GaussianEstimator(), low, high)
                    amp = np.abs(tf)
                    db = np.where(amp > 0, 20 * np.log10(np.maximum(amp, 1e-12) / max(amp.max(), 1e-12)) + 80, 0).clip(0)
                    on = np.array([np.interp(grid, f, c) for c in db.T])
                    ti, bi = np.meshgrid(np.arange(len(t)), np.arange(bands), indexing="ij")
                    yield pd.DataFrame({KEY: name, "window": w, "t_idx": ti.ravel(), "band": bi.ravel(), "x": on.ravel()})

    rows = arrays.select(KEY, "x").mapInPandas(run, f"{KEY} string, window double, t_idx long, band long, x double")
    out = rows.groupBy(KEY, "t_idx", "band").agg(F.avg("x").alias("x"), F.stddev_samp("x").alias("sd"))
    if mask_gain is None:
        return out.drop("sd")
    top = F.percentile("sd", F.lit(0.95)).over(Window.partitionBy(KEY))
    return out.select(KEY, "t_idx", "band", (F.col("x") / (1 + F.exp(mask_gain * (F.col("sd") / top - 0.5)))).alias("x"))


# --- multitaper -----------------------------------------------------------------------------------------------------


def taper_spectra(frames: DataFrame, size: int, nw: float = 3, group: list[str] | None = None) -> DataFrame:
    """(group, signal_id, frame, taper, k, re, im): detrended frames under 2 nw - 1 Slepian tapers, transformed."""
    keys = [*(group or []), KEY, "frame"]
    tapers, _ = K.dpss(size, nw, int(2 * nw - 1))
    arrays = gather(frames, *keys, order="m")
    places = (len(tapers), size // 2 + 1)
    taper, k = (v.ravel() for v in np.indices(places))

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                some = pdf.iloc[lo : lo + 64]
                x = np.array([K.detrend(np.asarray(v, float)) for v in some["x"]])
                z = np.fft.rfft(x[:, None, :] * tapers[None]).reshape(len(some), -1)
                named = {c: np.repeat(some[c].to_numpy(), taper.size) for c in keys}
                yield pd.DataFrame({**named, "taper": np.tile(taper, len(some)), "k": np.tile(k, len(some)), "re": z.real.ravel(), "im": z.imag.ravel()})

    kinds = dict(arrays.dtypes)
    return arrays.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "taper int", "k int", "re double", "im double"]))


def frame_arrays(signals: DataFrame, size: int, overlap: float, group: list[str] | None = None) -> DataFrame:
    """(group, frame, names, m, x): the frames of ``samples.chunk``, the channels of each in one row, as places and samples.

    What is past a signal's end is left out; a kernel fills it with zeros.
    """
    keys, hop = [*(group or [])], size - int(size * overlap)
    sized = signals.select(*keys, KEY, "n", "x", (F.max("n").over(Window.partitionBy(*keys, KEY)) + 1).alias("len"))
    frames = F.greatest(F.floor((F.col("len") - hop) / hop) + F.when(F.col("len") % hop != 0, 1).otherwise(0), F.lit(1))
    first = F.greatest(F.ceil((F.col("n") - size + 1) / hop), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("n") / hop), frames - 1).cast("int")
    held = sized.filter(first <= last).select(*keys, KEY, F.explode(F.sequence(first, last)).alias("frame"), "n", "x")
    # a channel's samples of a frame meet first, then the channels
    per = held.groupBy(*keys, "frame", KEY).agg(F.collect_list((F.col("n") - F.col("frame") * hop).cast("int")).alias("m"), F.collect_list("x").alias("x"))
    met = per.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct(KEY, "m", "x"))).alias("c"))
    return met.select(*keys, "frame", F.col(f"c.{KEY}").alias("names"), F.col("c.m").alias("m"), F.col("c.x").alias("x"))


def taper_cross_spectra(signals: DataFrame, size: int, overlap: float = 0.5, nw: float = 3, group: list[str] | None = None) -> DataFrame:
    """(group, frame, k, a, b, re, im, pa, pb): conj(X_a) X_b and both powers of the channel pairs a < b of every frame, averaged
    over the tapers of detrended frames.

    The channels of a frame meet in one row, so pairs are formed in arrays and no spectrum is shuffled.
    """
    keys = [*(group or []), "frame"]
    tapers, _ = K.dpss(size, nw, int(2 * nw - 1))
    k, met = np.arange(size // 2 + 1), frame_arrays(signals, size, overlap, group)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.zeros((len(row.names), size))
                for own, m, v in zip(x, row.m, row.x, strict=True):
                    own[np.asarray(m)] = v
                z = np.fft.rfft(np.array([K.detrend(v) for v in x])[:, None, :] * tapers[None])
                first, second = np.triu_indices(len(x), 1)
                pairs, power = (np.conj(z[first]) * z[second]).mean(axis=1), (np.abs(z) ** 2).mean(axis=1)
                names = np.array(row.names, object)
                out = {"k": np.tile(k, len(first)), "a": np.repeat(names[first], k.size), "b": np.repeat(names[second], k.size)}
                out |= {"re": pairs.real.ravel(), "im": pairs.imag.ravel(), "pa": power[first].ravel(), "pb": power[second].ravel()}
                yield pd.DataFrame({**{c: [getattr(row, c)] * len(out["k"]) for c in keys}, **out})

    kinds = dict(met.dtypes)
    return met.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "k int, a string, b string, re double, im double, pa double, pb double"]))


def multitaper_coherence(signals: DataFrame, rate: float = 1, size: int = 1024, overlap: float = 0.5, nw: float = 3, group: str | None = None) -> DataFrame:
    """(group, a, b, k, freq, re, im, coherence, lower, upper) of all channel pairs a < b, of each group apart.

    Cross-spectra average over tapers and sum over chunks; leaving a chunk out is the sum less that chunk, so one window
    gives all pseudovalues. Bounds are two standard errors of the jackknifed arctanh of the coherency's size.
    """
    keys = [group] if group else []
    per = taper_cross_spectra(signals, size, overlap, nw, keys)
    whole = Window.partitionBy(*keys, "k", "a", "b")
    pairs = per.select("*", *[F.sum(c).over(whole).alias(f"s{c}") for c in ("re", "im", "pa", "pb")], F.count("*").over(whole).alias("n"))
    scale = F.sqrt(F.col("spa") * F.col("spb"))
    left = F.sqrt((F.col("spa") - F.col("pa")) * (F.col("spb") - F.col("pb")))
    most = F.lit(1 - 1e-12)
    g_all = F.atanh(F.least(F.hypot("sre", "sim") / scale, most))
    g_out = F.atanh(F.least(F.hypot(F.col("sre") - F.col("re"), F.col("sim") - F.col("im")) / left, most))
    pseudo = pairs.select(*keys, "k", "a", "b", (F.col("sre") / scale).alias("cre"), (F.col("sim") / scale).alias("cim"), (F.col("n") * g_all - (F.col("n") - 1) * g_out).alias("g"))
    out = pseudo.groupBy(*keys, "k", "a", "b").agg(F.first("cre").alias("re"), F.first("cim").alias("im"), F.avg("g").alias("g"), F.sqrt(F.var_pop("g") / F.count("*")).alias("se"))

    def back(v: Column) -> Column:
        return F.pow(F.tanh(F.greatest(v, F.lit(0.0))), F.lit(2.0))

    return out.select(*keys, "a", "b", "k", (F.col("k") * rate / size).alias("freq"), "re", "im", back(F.col("g")).alias("coherence"), back(F.col("g") - 2 * F.col("se")).alias("lower"), back(F.col("g") + 2 * F.col("se")).alias("upper"))


def split_half_coherence(trials: DataFrame, rate: float, size: int, permutations: int = 5, seed: int = 0, nw: float = 3) -> DataFrame:
    """(perm, k, freq, coherence) between the mean signals of two halves of the trials (trial, n, x), per permutation.

    A trial's half follows from an MD5 of seed, permutation and trial; all permutations run in one plan, as groups.
    """
    perms = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))
    spread_ = trials.select("trial", "n", "x", perms.alias("perm"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("trial").cast("string")).cast("binary"))
    half = F.when(F.substring(digest, 1, 1) < "8", "a").otherwise("b")
    means = spread_.groupBy("perm", half.alias(KEY), "n").agg(F.avg("x").alias("x"))
    return multitaper_coherence(means, rate, size, 0.5, nw, "perm").select("perm", "k", "freq", "coherence")


def multitaper_power(signals: DataFrame, rate: float, size: int, nw: float = 3) -> DataFrame:
    """(signal_id, k, freq, power, std): multitaper power of chunks without overlap, mean and sample deviation over them."""
    spectra = taper_spectra(chunk(signals, size, 0.0), size, nw)
    per = spectra.groupBy(KEY, "frame", "k").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    return per.groupBy(KEY, "k").agg((F.first("k") * rate / size).alias("freq"), F.avg("p").alias("power"), F.stddev_samp("p").alias("std"))


def lag_coherency(cf: DataFrame, first: DataFrame, second: DataFrame, noise_db: float | None = None, fraction: float | None = None) -> DataFrame:
    """(lag, coherency) from a cross-correlogram and both autocorrelograms (lag, cf) on symmetric lags; small arrays, one task."""
    joined = cf.join(first.select("lag", F.col("cf").alias("a")), "lag").join(second.select("lag", F.col("cf").alias("b")), "lag")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        lag = rows["lag"].to_numpy()
        w = np.exp(-(lag**2) / (fraction * np.abs(lag).max()) ** 2) if fraction else np.ones(len(lag))
        c, a, b = (np.fft.fft(np.fft.ifftshift(rows[k].to_numpy() * w)) for k in ("cf", "a", "b"))
        z = c / np.sqrt(np.maximum(np.abs(a) * np.abs(b), 1e-300))
        if noise_db is not None:
            power = 10 * np.log10(np.maximum(np.abs(c), 1e-300) / np.abs(c).max())
            z = np.where(power < -noise_db, 0, z)
        return pd.DataFrame({"lag": lag, "coherency": np.fft.fftshift(np.real(np.fft.ifft(z)))})

    return joined.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "lag int, coherency double")


def wiener_filter(cross: DataFrame, auto: DataFrame, output: DataFrame | None = None) -> DataFrame:
    """(k, re, im): Hann-windowed cross-correlogram over the input's autocorrelogram in frequency.

    With the output's autocorrelogram also coherence: the cross-spectrum's squared size over both powers. Without lags but
    0 the one row is the regression coefficient (and the squared correlation).
    """
    joined = cross.join(auto.select("lag", F.col("cf").alias("a")), "lag")
    schema = "k int, re double, im double"
    if output is not None:
        joined, schema = joined.join(output.select("lag", F.col("cf").alias("b")), "lag"), schema + ", coherence double"
    both = output is not None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        w = np.hanning(len(rows)) if len(rows) > 1 else np.ones(1)
        c, *own = (np.fft.rfft(np.fft.ifftshift(rows[v].to_numpy() * w)) for v in ("cf", "a", "b") if v in rows)
        power = [np.maximum(np.abs(v), 1e-300) for v in own]
        out = {"k": np.arange(len(c)), "re": (c / power[0]).real, "im": (c / power[0]).imag}
        if both:
            out["coherence"] = np.abs(c) ** 2 / (power[0] * power[1])
        return pd.DataFrame(out)

    return joined.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, schema)


def acf_spectrum(acf: DataFrame) -> DataFrame:
    """(k, power): |FFT(acf)|^2."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.abs(np.fft.rfft(np.fft.ifftshift(rows.sort_values("lag")["cf"].to_numpy()))) ** 2
        return pd.DataFrame({"k": np.arange(len(p)), "power": p})

    return acf.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "k int, power double")


# --- sounds and modes -----------------------------------------------------------------------------------------------

FEATURES = (
    "q1 double, q2 double, q3 double, meanspect double, stdspect double, skewspect double, kurtosisspect double, entropyspect double, meantime double, stdtime double, "
    "skewtime double, kurtosistime double, entropytime double, maxAmp double, rms double, fund double, maxfund double, minfund double, cvfund double, meansal double, "
    "fund2 double, voice2percent double, f0 array<double>, f0_2 array<double>, sal array<double>, F1 array<double>, F2 array<double>, F3 array<double>, fpsd array<double>, "
    "psd array<double>, tAmp array<double>, amp array<double>"
)


def sound_features(sounds: DataFrame, rate: float, top: float = 10000, method: str = "HPS", lowest: float = 300, highest: float = 1500, with_pitch: bool = True, key: str = KEY) -> DataFrame:
    """One feature record per (key, x); missing values are null. The hash is over all sample bytes."""
    names = [p.split()[0] for p in FEATURES.split(", ")]

    def run(batches):
        for rows in batches:
            out = []
            for name, x in zip(rows[key], rows["x"], strict=True):
                f = V.features(np.asarray(x, float), rate, top, method, lowest, highest, with_pitch)
                out.append({key: name} | {n: (np.where(np.isfinite(f[n]), f[n], None).tolist() if isinstance(f.get(n), np.ndarray) else (None if f.get(n) is None or np.isnan(f[n]) else f[n])) for n in names})
            yield pd.DataFrame(out, columns=[key, *names])

    found = sounds.select(key, "x").mapInPandas(run, f"{key} string, {FEATURES}")
    hashes = sounds.select(F.col(key).alias("_key"), F.md5(F.array_join(F.transform("x", lambda v: v.cast("string")), ",").cast("binary")).alias("hashid"))
    return found.join(hashes, F.col(key) == F.col("_key")).drop("_key")


def modes(arrays: DataFrame, key: str = KEY, most: int = 10) -> DataFrame:
    """(key, imf, n, value, amp, phase): empirical modes of every signal with their Hilbert amplitude and phase; the last is the rest."""

    def run(batches):
        for rows in batches:
            for name, x in zip(rows[key], rows["x"], strict=True):
                for i, m in enumerate(E.emd(np.asarray(x, float), most)):
                    z = K.analytic(m)
                    yield pd.DataFrame({key: name, "imf": i, "n": np.arange(len(m)), "value": m, "amp": np.abs(z), "phase": np.angle(z)})

    return arrays.select(key, "x").mapInPandas(run, f"{key} string, imf int, n int, value double, amp double, phase double")


def multi_modes(signals: DataFrame, count: int = 3, directions: int = 8, group: str | None = None) -> DataFrame:
    """(group, signal_id, imf, n, value): multichannel modes of the channels of each group together, groups in parallel.

    Sifting needs all channels of a group at all times, so a group is one task; frame long recordings and group by frame.
    """
    keys = [group] if group else ["_one"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index=KEY, columns="n", values="x")
        out = E.memd(wide.to_numpy(), count, directions)
        parts = [pd.DataFrame({KEY: name, "imf": i, "n": wide.columns, "value": out[i, c]}) for i in range(len(out)) for c, name in enumerate(wide.index)]
        return pd.concat(parts).assign(**{k: rows[k].iloc[0] for k in keys})[[*keys, KEY, "imf", "n", "value"]]

    kept = signals.select(*([group] if group else [F.lit(1).alias("_one")]), KEY, "n", "x")
    kind = dict(kept.dtypes)[keys[0]]
    out = kept.groupBy(*keys).applyInPandas(run, f"`{keys[0]}` {kind}, {KEY} string, imf int, n int, value double")
    return out if group else out.drop("_one")

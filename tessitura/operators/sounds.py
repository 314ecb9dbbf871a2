"""Whole-sound operators: analysis of a recording, spectrograms and their modulation, pitch tracks, ensembles and envelopes.

Each maps (signal_id, x array) to rows in Arrow batches, one signal a row, so signals run in parallel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions import emd_kernels as E
from tessitura.functions import kernels as K
from tessitura.functions import learn_kernels as L
from tessitura.functions import sound_kernels as V
from tessitura.operators.samples import KEY, rows_of


def _grid(values: np.ndarray, **axes: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of a matrix: its two axes, each repeated along the other, and its values."""
    (first, a), (second, b) = axes.items()
    return {first: np.repeat(a, len(b)), second: np.tile(b, len(a)), "value": values.ravel()}


def line_spectrum(arrays: DataFrame, rate: float, low: float = 0, high: float | None = None) -> DataFrame:
    """(signal_id, k, freq, power): log10 |FFT| at frequencies over ``low`` (strictly, so without DC) and under ``high``."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        freq = np.fft.fftfreq(len(x), 1 / rate)
        at = np.flatnonzero((freq > low) & (freq < (np.inf if high is None else high)))
        return {"k": at, "freq": freq[at], "power": np.log10(np.maximum(np.abs(np.fft.fft(x)[at]), 1e-300))}

    return rows_of(arrays, run, "k int, freq double, power double")


def log_spectrogram_rows(arrays: DataFrame, rate: float, spec_rate: float = 1000.0, spacing: float = 125.0, low: float = 0, high: float | None = None, noise_db: float = 80, rectify: bool = True) -> DataFrame:
    """(signal_id, f_idx, t_idx, value): Gaussian spectrogram in decibels of its largest value above ``-noise_db``, never under 0
    if rectified."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        _, f, s = K.spectrogram(x, rate, spec_rate, spacing, low, high, cmplx=False)
        db = 20 * np.log10(np.maximum(s, 1e-300) / max(s.max(), 1e-300)) + noise_db
        return _grid(np.maximum(db, 0) if rectify else db, f_idx=np.arange(len(f)), t_idx=np.arange(s.shape[1]))

    return rows_of(arrays, run, "f_idx int, t_idx int, value double")


def analyze(arrays: DataFrame, rate: float, low: float = 0, high: float | None = None, spec_rate: float = 1000.0, spacing: float = 125.0, cut: float = 200.0, noise_db: float = 80, rectify: bool = True) -> DataFrame:
    """(signal_id, envelope, fundamental, power, spectrogram): what a recording is looked at for first, as one record.

    envelope: low-passed size; power: structs (freq, power) of the log spectrum; fundamental: the frequency of its largest
    entry, 0 without any; spectrogram: structs (f_idx, t_idx, value). The plan is lazy; other settings make another record.
    """
    envelope = rows_of(arrays, lambda x: {"envelope": [K.envelope(x, rate, cut)]}, "envelope array<double>")
    lines = line_spectrum(arrays, rate, low, high).groupBy(KEY).agg(
        F.max_by("freq", F.struct("power", -F.col("freq"))).alias("fundamental"), F.array_sort(F.collect_list(F.struct("freq", "power"))).alias("power")
    )
    spectra = log_spectrogram_rows(arrays, rate, spec_rate, spacing, low, high, noise_db, rectify).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("f_idx", "t_idx", "value"))).alias("spectrogram"))
    return envelope.join(lines, KEY, "left").join(spectra, KEY).select(KEY, "envelope", F.coalesce("fundamental", F.lit(0.0)).alias("fundamental"), "power", "spectrogram")


def amplitude_moments(arrays: DataFrame, rate: float, cut: float = 20, amp_rate: float | None = 1000) -> DataFrame:
    """(signal_id, max_amp, mean, std, skew, kurtosis, entropy): the envelope's top, and moments of time under its weight."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        amp = K.envelope(x, rate, cut, amp_rate)
        t = np.arange(len(amp)) / (amp_rate or rate)
        return {"max_amp": np.array([amp.max()]), **{k: np.array([v]) for k, v in zip(("mean", "std", "skew", "kurtosis", "entropy"), V._moments(t, amp), strict=True)}}

    return rows_of(arrays, run, "max_amp double, mean double, std double, skew double, kurtosis double, entropy double")


def pitch_tracks(sounds: DataFrame, rate: float, method: str = "HPS", lowest: float = 300, highest: float = 1500, **options) -> DataFrame:
    """(signal_id, t, f0, f0_2, sal, sal_2) at every hop; NaN where there is no pitch. Methods: AC, ACA, Cep, HPS, Stack."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        return V.fundamental(x, rate, method, lowest, highest, **options)

    return rows_of(sounds, run, "t double, f0 double, f0_2 double, sal double, sal_2 double")


def formant_tracks(sounds: DataFrame, rate: float, **options) -> DataFrame:
    """(signal_id, frame, f1, f2, f3) at every hop; NaN where a resonance is missing."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        f = V.formants(x, rate, **options)
        return {"frame": np.arange(len(f)), "f1": f[:, 0], "f2": f[:, 1], "f3": f[:, 2]}

    return rows_of(sounds, run, "frame int, f1 double, f2 double, f3 double")


def comb_residual(spectra: DataFrame, params: list[float]) -> DataFrame:
    """(signal_id, freq, model, residual) of (signal_id, freq, value): a comb of Gaussians at the multiples of params[0], with
    amplitudes params[1:], and what it leaves of the spectrum; expressions only."""
    model = sum((float(a) * F.exp(-F.pow(F.col("freq") - float(k * params[0]), F.lit(2.0)) / (2 * V.COMB_WIDTH**2)) for k, a in enumerate(params[1:], 1)), F.lit(0.0))
    return spectra.select(KEY, "freq", model.alias("model"), (F.col("value") - model).alias("residual"))


# --- modulation of spectrograms -------------------------------------------------------------------------------------


def _matrices(spectra: DataFrame) -> DataFrame:
    """(signal_id, x): spectrograms (signal_id, f_idx, t_idx, value) as arrays in order of frequency, then time, led by their size."""
    cells = F.array_sort(F.collect_list(F.struct("f_idx", "t_idx", "value")))
    grouped = spectra.groupBy(KEY).agg(cells.alias("c"), (F.max("f_idx") + 1).alias("nf"))
    return grouped.select(KEY, F.concat(F.array(F.col("nf").cast("double")), F.transform("c", lambda c: c["value"])).alias("x"))


def _matrix(x: np.ndarray) -> np.ndarray:
    return x[1:].reshape(int(x[0]), -1)


def modulation_power(spectra: DataFrame, df: float, dt: float, reverse_time: bool = False, half: bool = False) -> DataFrame:
    """(signal_id, wf, wt, power, phase): shifted 2-D transform of whole spectrograms (signal_id, f_idx, t_idx, value).

    ``reverse_time`` is for receptive fields, whose time runs backwards; ``half`` keeps wf >= 0.
    """

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        own = _matrix(x)
        wf, wt, power, phase = K.mtfft(own[:, ::-1] if reverse_time else own, df, dt)
        keep = wf >= 0 if half else np.ones(len(wf), bool)
        return {"wf": np.repeat(wf[keep], len(wt)), "wt": np.tile(wt, keep.sum()), "power": power[keep].ravel(), "phase": phase[keep].ravel()}

    return rows_of(_matrices(spectra), run, "wf double, wt double, power double, phase double")


def filter_modulation(spectra: DataFrame, df: float, dt: float, keep=lambda wf, wt: np.ones(np.broadcast(wf, wt).shape, bool)) -> DataFrame:
    """(signal_id, f_idx, t_idx, value): spectrograms through their modulation spectrum and back, with the entries that ``keep``
    (of wf and wt, by broadcasting) lets through."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        own = _matrix(x)
        z = np.fft.fftshift(np.fft.fft2(own))
        wf, wt = np.fft.fftshift(np.fft.fftfreq(own.shape[0], df)), np.fft.fftshift(np.fft.fftfreq(own.shape[1], dt))
        back = np.real(np.fft.ifft2(np.fft.ifftshift(z * keep(wf[:, None], wt[None, :]))))
        return _grid(back, f_idx=np.arange(own.shape[0]), t_idx=np.arange(own.shape[1]))

    return rows_of(_matrices(spectra), run, "f_idx int, t_idx int, value double")


def regrid(spectra: DataFrame, df: float, dt: float, new_df: float, new_dt: float) -> DataFrame:
    """(signal_id, f_idx, t_idx, value): spectrograms on a grid with new spacings from 0, by tensor cubic splines."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        own = _matrix(x)
        t, f, out = K.resample_grid(np.arange(own.shape[1]) * dt, np.arange(own.shape[0]) * df, own, new_dt, new_df)
        return _grid(out, f_idx=np.arange(len(f)), t_idx=np.arange(len(t)))

    return rows_of(_matrices(spectra), run, "f_idx int, t_idx int, value double")


def griffin_lim(spectra: DataFrame, size: int, rate: float, spec_rate: float, spacing: float, iterations: int = 10) -> DataFrame:
    """(signal_id, n, x): signals of ``size`` samples whose spectrograms have the given amplitudes, by alternating projections."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        return {"n": np.arange(size), "x": K.griffin_lim(_matrix(x), size, rate, spec_rate, spacing, 0, iterations)}

    return rows_of(_matrices(spectra), run, "n int, x double")


def reassign(spectra: DataFrame, df: float, dt: float, by: str = "amplitude") -> DataFrame:
    """(signal_id, f_idx, t_idx, value): every bin of a spectrogram moved along the gradient of its amplitude (or of the phase, if
    ``value`` holds phases and amplitude is 1) by one bin at most in each direction, and summed where it lands."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        own = _matrix(x)
        slope_f, slope_t = np.gradient(np.unwrap(np.unwrap(own, axis=0), axis=1) if by == "phase" else own)
        size = np.maximum(np.hypot(slope_f, slope_t), 1e-300)
        to_f = np.clip(np.arange(own.shape[0])[:, None] + np.rint(slope_f / size).astype(int), 0, own.shape[0] - 1)
        to_t = np.clip(np.arange(own.shape[1])[None] + np.rint(slope_t / size).astype(int), 0, own.shape[1] - 1)
        out = np.zeros_like(own)
        np.add.at(out, (to_f, to_t), np.ones_like(own) if by == "phase" else own)
        return _grid(out, f_idx=np.arange(own.shape[0]), t_idx=np.arange(own.shape[1]))

    return rows_of(_matrices(spectra), run, "f_idx int, t_idx int, value double")


# --- modes and phases -----------------------------------------------------------------------------------------------


def ensemble_modes(arrays: DataFrame, samples: int = 10, gain: float = 0.2, seed: int = 0, most: int = 10) -> DataFrame:
    """(signal_id, imf, n, mean, sd): modes averaged over noisy copies of a signal, and their deviation."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        mean, sd = E.ensemble(x, samples, gain, seed, most_modes=most)
        return {"imf": np.repeat(np.arange(len(mean)), len(x)), "n": np.tile(np.arange(len(x)), len(mean)), "mean": mean.ravel(), "sd": sd.ravel()}

    return rows_of(arrays, run, "imf int, n int, mean double, sd double")


def normalized_hilbert(arrays: DataFrame, rate: float) -> DataFrame:
    """(signal_id, n, amp, phase, freq): amplitude by repeated division by the envelope, phase by the arc cosine."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        amp, phase, freq = E.normalized_hilbert(x, rate)
        return {"n": np.arange(len(x)), "amp": amp, "phase": phase, "freq": freq}

    return rows_of(arrays, run, "n int, amp double, phase double, freq double")


def demodulate(analytic: DataFrame, over_space: bool = True, depth: int = 1, group: str | None = None) -> DataFrame:
    """(group, signal_id, n, re, im): complex channels with the phase of their leading component taken out, groups apart."""
    import pandas as pd

    keys = [group] if group else []

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = {c: rows.pivot(index=KEY, columns="n", values=c) for c in ("re", "im")}
        z = L.demodulate(wide["re"].to_numpy() + 1j * wide["im"].to_numpy(), over_space, depth)
        names, times = wide["re"].index, wide["re"].columns
        out = pd.DataFrame({KEY: np.repeat(names, len(times)), "n": np.tile(times, len(names)), "re": z.real.ravel(), "im": z.imag.ravel()})
        return out.assign(**{k: rows[k].iloc[0] for k in keys})[[*keys, KEY, "n", "re", "im"]]

    kept = analytic.select(*keys, KEY, F.col("n").cast("int").alias("n"), "re", "im")
    return (kept if keys else kept.withColumn("_one", F.lit(1))).groupBy(*(keys or ["_one"])).applyInPandas(run, kept.schema)

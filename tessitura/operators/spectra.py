"""Spectra: whole signals by FFT in Arrow batches, short frames as a join with their frequencies on the JVM; coherence and
spectrum statistics in relational form."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.samples import KEY, gather, rows_of


def dft(frames: DataFrame, keys: list[str], index: str, size: int, ks: list[int]) -> DataFrame:
    """(keys, k, re, im): each sample meets every frequency of a literal list and sums combine map-side.

    Angles use k * n mod size, so large products lose no precision.
    """
    wide = frames.select(*keys, index, "x", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    angle = 2 * math.pi * F.pmod(F.col("k").cast("long") * F.col(index), F.lit(size)) / size
    return wide.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), (-F.sum(F.col("x") * F.sin(angle))).alias("im"))


def power_spectrum(signals: DataFrame, size: int, rate: float, log: bool = False, hann: bool = False) -> DataFrame:
    """(signal_id, k, freq, power): |FFT|^2 over ``size`` points at the frequencies from 0 up to but not the Nyquist of an even size.

    Signals are padded with zeros to ``size`` (or cut). ``hann`` applies a symmetric Hann window first; ``log`` gives
    20 log10(power / max). One FFT a signal, so a million samples are a matter of a fraction of a second.
    """

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        x = np.pad(x[:size], (0, max(0, size - len(x))))
        power = np.abs(np.fft.rfft(x * np.hanning(size) if hann else x)[: (size + 1) // 2]) ** 2
        if log:
            power = 20 * np.log10(np.maximum(power, 1e-300) / max(power.max(), 1e-300))
        k = np.arange(len(power))
        return {"k": k, "freq": k * rate / size, "power": power}

    return rows_of(gather(signals), run, "k int, freq double, power double")


def cross_spectra(spectra: DataFrame, keys: list[str], channel: str = KEY) -> DataFrame:
    """(keys, a, b, re, im): conj(X_a) X_b of all channel pairs a <= b that share the keys (an equi-join)."""
    a = spectra.select(*keys, F.col(channel).alias("a"), F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = spectra.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(channel).alias("b"), F.col("re").alias("br"), F.col("im").alias("bi"))
    pairs = a.join(b, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("a") <= F.col("b")])
    return pairs.select(*keys, "a", "b", (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("re"), (F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")).alias("im"))


def coherency(summed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, re, im, coherence): cross-spectra over the root of both channels' own power."""
    own = summed.filter("a = b").select(*keys, F.col("a").alias("channel"), F.col("re").alias("power"))
    left = own.select(*keys, F.col("channel").alias("a"), F.col("power").alias("pa"))
    right = own.select(*keys, F.col("channel").alias("b"), F.col("power").alias("pb"))
    scale = F.sqrt(F.col("pa") * F.col("pb"))
    out = summed.filter("a < b").join(left, [*keys, "a"]).join(right, [*keys, "b"])
    return out.select(*keys, "a", "b", (F.col("re") / scale).alias("re"), (F.col("im") / scale).alias("im"), ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("pa") * F.col("pb"))).alias("coherence"))


def welch_coherence(frames: DataFrame, size: int, ks: list[int]) -> DataFrame:
    """Magnitude-squared coherence of all channel pairs over frames (signal_id, frame, m, x): mean removed, Hann window."""
    mean = F.avg("x").over(Window.partitionBy(KEY, "frame"))
    tapered = frames.select(KEY, "frame", "m", ((F.col("x") - mean) * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("m") / size))).alias("x"))
    pairs = cross_spectra(dft(tapered, [KEY, "frame"], "m", size, ks), ["frame", "k"])
    summed = pairs.groupBy("k", "a", "b").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return coherency(summed, ["k"])


def jackknife_power(frame_spectra: DataFrame) -> DataFrame:
    """(k, power, variance, phase) over frames (frame, k, re, im): mean power, jackknife variance of the complex mean's size, phase of the sum."""
    per = Window.partitionBy("k")
    n = F.count("*").over(per)
    lr, li = (F.sum("re").over(per) - F.col("re")) / (n - 1), (F.sum("im").over(per) - F.col("im")) / (n - 1)
    left_out = frame_spectra.select("k", "re", "im", n.alias("n"), F.hypot(lr, li).alias("loo"))
    off = F.pow(F.col("loo") - F.avg("loo").over(per), F.lit(2.0))
    return left_out.select("*", off.alias("off")).groupBy("k").agg(
        F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), (F.sum("off") * (F.first("n") - 1) / F.first("n")).alias("variance"), F.atan2(F.sum("im"), F.sum("re")).alias("phase")
    )


def spec_stats(spec: DataFrame) -> DataFrame:
    """(t, mean_freq, q1, q2, q3) per time slice of (t, f, x), as shares of what stands above the least value of all."""
    low = spec.agg(F.min("x").alias("low"))
    lifted = spec.crossJoin(F.broadcast(low)).select("t", "f", (F.col("x") - F.col("low")).alias("x"))
    whole = Window.partitionBy("t")
    p = lifted.select("t", "f", (F.col("x") / F.sum("x").over(whole)).alias("p"))
    run = F.sum("p").over(whole.orderBy("f").rowsBetween(Window.unboundedPreceding, 0))
    q = [F.coalesce(F.max(F.when(F.col("run") <= s, F.col("f"))), F.lit(0.0)).alias(f"q{i}") for i, s in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return p.select("t", "f", "p", run.alias("run")).groupBy("t").agg(F.sum(F.col("p") * F.col("f")).alias("mean_freq"), *q)


def strf_correlation(first: DataFrame, second: DataFrame, times: int, freqs: int, max_delay: int = 10) -> DataFrame:
    """(delay, roll, corr): the normalised product of two (i, j, w) kernels of largest size over time shifts and circular frequency rolls.

    Shifts and rolls explode on the first kernel only and meet the second in an equi-join; ties go to the first shift, then roll.
    """
    moves = F.explode(F.sequence(F.lit(-max_delay), F.lit(max_delay)))
    moved = first.select("i", "j", "w", moves.alias("delay")).select("*", F.explode(F.sequence(F.lit(0), F.lit(freqs - 1))).alias("roll"))
    moved = moved.select((F.col("i") + F.col("delay")).alias("i"), F.pmod(F.col("j") + F.col("roll"), F.lit(freqs)).alias("j"), F.col("w").alias("a"), "delay", "roll")
    met = moved.filter((F.col("i") >= 0) & (F.col("i") < times)).join(second.select("i", "j", F.col("w").alias("b")), ["i", "j"])
    sums = met.groupBy("delay", "roll").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    norms = first.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na")).crossJoin(second.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb")))
    scored = sums.crossJoin(F.broadcast(norms)).select("delay", "roll", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("corr"))
    best = F.max_by(F.struct("delay", "roll", "corr"), F.struct(F.abs(F.round("corr", 9)), -F.col("delay"), -F.col("roll"))).alias("m")
    return scored.agg(best).select("m.delay", "m.roll", "m.corr")

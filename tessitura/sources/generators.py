"""Generated sources: tones, harmonic stacks, receptive-field kernels, quasi-random points, random spike trains."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _times(spark: SparkSession, duration: float, rate: float) -> DataFrame:
    return spark.range(math.ceil(duration * rate - 1e-9)).select(F.col("id").cast("int").alias("n"), (F.col("id") / rate).alias("t"))


def sine_wave(spark: SparkSession, duration: float, freq: float, rate: float) -> DataFrame:
    """(n, x) = sin(2 pi f t)."""
    return _times(spark, duration, rate).select("n", F.sin(2 * math.pi * freq * F.col("t")).alias("x"))


def _stack(spark: SparkSession, duration: float, rate: float, freqs: list[float]) -> DataFrame:
    return _times(spark, duration, rate).select("n", sum((F.sin(2 * math.pi * f * F.col("t")) for f in freqs), F.lit(0.0)).alias("x"))


def simple_stack(spark: SparkSession, duration: float, fundamental: float, rate: float, harmonics: int = 10) -> DataFrame:
    """Sum of the harmonics k f0, k = 1 .. harmonics."""
    return _stack(spark, duration, rate, [k * fundamental for k in range(1, harmonics + 1)])


def harmonic_stack(spark: SparkSession, duration: float, fundamental: float, rate: float, harmonics: int = 10, base: float = 2) -> DataFrame:
    """Sum of f0 base^k, k = 0 .. harmonics - 1."""
    return _stack(spark, duration, rate, [fundamental * base**k for k in range(harmonics)])


def _grid(spark: SparkSession, ts: list[float], fs: list[float]) -> DataFrame:
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("t")) for i, v in enumerate(ts)])).alias("a")
    f = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.lit(float(v)).alias("f")) for i, v in enumerate(fs)])).alias("b")
    return spark.range(1).select(t).select("a.*", f).select("i", "t", "b.*")


def _peak_scaled(grid: DataFrame, value) -> DataFrame:
    raw = grid.select("i", "j", value.alias("w"))
    top = F.broadcast(raw.agg(F.max(F.abs("w")).alias("top")))
    return raw.crossJoin(top).select("i", "j", (F.col("w") / F.col("top")).alias("w"))


def onset_strf(spark, ts, fs, t_c=0.15, t_freq=10.0, t_phase=0.0, t_sigma=0.25, f_c=3000.0, f_sigma=500.0) -> DataFrame:
    """(i, j, w): sine in time under Gaussians in time and frequency, largest size 1."""
    g = _grid(spark, ts, fs)
    t, f = F.col("t"), F.col("f")
    return _peak_scaled(g, F.sin(2 * math.pi * t_freq * (t - t_c) + t_phase) * F.exp(-F.pow(f - f_c, F.lit(2.0)) / (2 * f_sigma**2)) * F.exp(-F.pow(t - t_c, F.lit(2.0)) / (2 * t_sigma**2)))


def checkerboard_strf(spark, ts, fs, t_freq=10.0, t_phase=0.0, f_freq=1e-6, f_phase=0.0, t_c=0.15, f_c=3000.0, t_sigma=0.05, f_sigma=500.0, harmonic=False) -> DataFrame:
    """(i, j, w): cosines in time and frequency under a Gaussian; ``harmonic`` takes the size of the frequency part."""
    g = _grid(spark, ts, fs)
    t, f = F.col("t"), F.col("f")
    part = F.cos(2 * math.pi * f_freq * f + f_phase)
    env = F.exp(-F.pow(f - f_c, F.lit(2.0)) / (2 * f_sigma**2)) * F.exp(-F.pow(t - t_c, F.lit(2.0)) / (2 * t_sigma**2))
    return _peak_scaled(g, F.cos(2 * math.pi * t_freq * t + t_phase) * (F.abs(part) if harmonic else part) * env)


def sweep_strf(spark, ts, fs, theta=0.0, aspect=1.0, phase=0.0, wavelength=0.5, spread=1.0, f_c=5000.0, t_c=0.0) -> DataFrame:
    """(i, j, w): rotated Gabor patch over centred axes, each scaled by its largest size; not rescaled afterwards."""
    dt, df = [v - t_c for v in ts], [v - f_c for v in fs]
    g = _grid(spark, [v / max(map(abs, dt)) for v in dt], [v / max(map(abs, df)) for v in df])
    a = F.col("t") * math.cos(theta) + F.col("f") * math.sin(theta)
    b = -F.col("t") * math.sin(theta) + F.col("f") * math.cos(theta)
    return g.select("i", "j", (F.exp(-(a * a + aspect**2 * b * b) / (2 * spread**2)) * F.cos(2 * math.pi * a / wavelength + phase)).alias("w"))


#: Direction numbers of Sobol sequences as Joe and Kuo published them (fixed values): for each dimension from the second on the
#: coefficients of its primitive polynomial, as one number, and the initial m.
JOE_KUO = (
    (0, (1,)), (1, (1, 3)), (1, (1, 3, 1)), (2, (1, 1, 1)), (1, (1, 1, 3, 3)), (4, (1, 3, 5, 13)), (2, (1, 1, 5, 5, 17)), (4, (1, 1, 5, 5, 5)),
    (7, (1, 1, 7, 11, 19)), (11, (1, 1, 5, 1, 1)), (13, (1, 1, 1, 3, 11)), (14, (1, 3, 5, 5, 31)), (1, (1, 3, 3, 9, 7, 49)), (13, (1, 1, 1, 15, 21, 21)),
    (16, (1, 3, 1, 13, 27, 49)), (19, (1, 1, 1, 15, 7, 5)), (22, (1, 3, 1, 15, 13, 25)), (25, (1, 1, 5, 5, 19, 61)), (1, (1, 3, 7, 11, 23, 15, 103)), (4, (1, 3, 7, 13, 13, 15, 69)),
)


def _sobol_direction(dimension: int, bits: int = 30) -> np.ndarray:
    """Direction numbers of a dimension, by the recurrence of its polynomial."""
    if dimension == 0:
        m = [1] * bits
    else:
        if dimension > len(JOE_KUO):
            raise ValueError(f"points have {len(JOE_KUO) + 1} dimensions at most")
        inner, first = JOE_KUO[dimension - 1]
        m, degree = list(first), len(first)
        for i in range(degree, bits):
            new = m[i - degree] ^ (m[i - degree] << degree)
            for k in range(1, degree):
                if inner >> (degree - 1 - k) & 1:
                    new ^= m[i - k] << k
            m.append(new)
    return np.array([v << (bits - 1 - i) for i, v in enumerate(m[:bits])], np.int64)


def quasirand(dimensions: int, points: int, spherical: bool = False, start: int = 0) -> np.ndarray:
    """(points, dimensions) Sobol points in [0, 1) from number ``start`` on, the very first (0) left out; ``spherical`` maps dimensions - 1 of them to angles from
    -pi to pi on the unit sphere."""
    bits, need = 30, dimensions - 1 if spherical else dimensions
    codes = np.arange(start + 1, start + points + 1)
    gray = codes ^ (codes >> 1)
    out = np.zeros((points, max(need, 1)))
    for j in range(max(need, 1)):
        v, x = _sobol_direction(j, bits), np.zeros(points, np.int64)
        for b in range(bits):
            x ^= np.where(gray >> b & 1, v[b], 0)
        out[:, j] = x / float(1 << bits)
    if not spherical:
        return out
    angles = out * (2 * np.pi - 1e-6) - (np.pi - 1e-6)
    sphere, rest = np.ones((points, dimensions)), np.ones(points)
    for j in range(dimensions - 1):
        sphere[:, j] = rest * np.cos(angles[:, j])
        rest = rest * np.sin(angles[:, j])
    sphere[:, -1] = rest
    return sphere


def quasirandom(spark: SparkSession, dimensions: int, points: int, spherical: bool = False) -> DataFrame:
    """(i, dim, value): Sobol points as rows, made on the executors from their numbers."""

    def run(batches):
        import pandas as pd

        for rows in batches:
            i = rows["id"].to_numpy()  # one run of numbers
            values = quasirand(dimensions, len(i), spherical, int(i[0]) if len(i) else 0)
            yield pd.DataFrame({"i": np.repeat(i, dimensions), "dim": np.tile(np.arange(dimensions), len(i)), "value": values.ravel()})

    return spark.range(points).mapInPandas(run, "i long, dim int, value double")


def simulate_poisson(rate: DataFrame, bin_size: float, trials: int, seed: int = 0) -> DataFrame:
    """(trial, t): random trains from (n, rate per second): a new exponential threshold after every spike, per trial."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        trial = int(rows["trial"].iloc[0])
        rng = np.random.default_rng([seed, trial])
        out, gone, limit = [], 0.0, rng.exponential()
        for n, r in zip(rows["n"], rows["rate"], strict=True):
            gone += r * bin_size
            while gone >= limit:
                out.append((trial, n * bin_size))
                limit += rng.exponential()
        return pd.DataFrame(out, columns=["trial", "t"])

    spread = rate.select("n", "rate", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    return spread.groupBy("trial").applyInPandas(run, "trial int, t double")


def simulate_gamma(rate: DataFrame, spikes: DataFrame, bin_size: float, trials: int, seed: int = 0) -> DataFrame:
    """(trial, t): trains with the intervals' gamma shape of ``spikes`` (trial, t) in time rescaled by the rate.

    Rescaled intervals come from a running sum of the rate and a lag; their mean and mean logarithm give the shape by maximum
    likelihood; new trains draw gamma intervals and map back through the running sum.
    """
    import pandas as pd

    total = Window.orderBy("n")
    cumulative = rate.select("n", F.sum(F.col("rate") * bin_size).over(total).alias("mass"))
    at = spikes.select("trial", "t", F.floor(F.col("t") / bin_size).cast("int").alias("n")).join(cumulative, "n")
    gaps = at.select((F.col("mass") - F.lag("mass").over(Window.partitionBy("trial").orderBy("t"))).alias("g")).filter("g > 0")
    stats = gaps.agg(F.avg("g").alias("mean"), F.avg(F.log("g")).alias("log")).first()
    s = math.log(stats["mean"]) - stats["log"] if stats["mean"] else 1.0
    shape = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) if s > 0 else 1.0
    scale = (stats["mean"] or 1.0) / shape

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        trial = int(rows["trial"].iloc[0])
        rng = np.random.default_rng([seed, trial])
        mass, n = rows["mass"].to_numpy(), rows["n"].to_numpy()
        size = int(mass[-1] / (shape * scale) * 2) + 20
        marks = np.cumsum(rng.gamma(shape, scale, size))
        marks = marks[marks < mass[-1]]
        return pd.DataFrame({"trial": trial, "t": n[np.searchsorted(mass, marks)] * bin_size})

    spread = cumulative.select("n", "mass", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    return spread.groupBy("trial").applyInPandas(run, "trial int, t double")


def random_psth(spark: SparkSession, duration: float, smooth: int = 10, rate: float = 1000.0, thresh: float = 0.5, seed: int = 0) -> DataFrame:
    """(n, rate): Gaussian noise, 0 under the threshold, smoothed by exp(-k^2) of area 1 over ``smooth`` samples on each side."""
    noise = spark.range(int(duration * rate)).select(F.col("id").cast("int").alias("n"), F.randn(seed).alias("z"))
    kept = noise.select("n", F.when(F.col("z") >= thresh, F.col("z")).otherwise(0.0).alias("z"))
    raw = {k: math.exp(-k * k) for k in range(-smooth, smooth + 1)}
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw.values())).alias("w")) for k, w in raw.items()]))
    near = kept.select("n", "z", taps.alias("t")).select((F.col("n") + F.col("t.k")).alias("n"), (F.col("z") * F.col("t.w")).alias("v"))
    return near.filter((F.col("n") >= 0) & (F.col("n") < int(duration * rate))).groupBy("n").agg(F.sum("v").alias("rate"))

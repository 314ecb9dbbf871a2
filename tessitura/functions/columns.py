"""Column expressions: sample-wise maps that stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329


def c_mul(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    """Product of two complex numbers."""
    return a_re * b_re - a_im * b_im, a_re * b_im + a_im * b_re


def c_conj_mul(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    """conj(a) * b."""
    return a_re * b_re + a_im * b_im, a_re * b_im - a_im * b_re


def c_abs(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def modulate_wave(x: Column, n: Column, rate: float, freq: float) -> Column:
    """A sample times sin(2 pi f t)."""
    return x * F.sin(2 * math.pi * freq * (n / F.lit(rate)))


def add_ramp(x: Column, n: Column, length: Column, rate: float = 44100, ramp_ms: float = 5) -> Column:
    """Raised-cosine ramps of int(ms * rate / 1000) samples (length - 1 at most) at both ends; the last sample is 0."""
    size = F.least(F.lit(int(ramp_ms * rate / 1000)), length - 1).cast("double")
    rise = 0.5 * (1 - F.cos(math.pi * n / size))
    fall = 0.5 * (1 + F.cos(math.pi * (n - (length - size)) / F.greatest(size - 1, F.lit(1.0))))
    out = F.when(n < size, x * rise).otherwise(x)
    return F.when(n >= length - size, out * fall).otherwise(out)


def log_spectrogram(x: Column, offset: float = 100) -> Column:
    """10 log10 x + offset, never under 0; 0 where x isn't positive."""
    return F.when(x > 0, F.greatest(10 * F.log10(x) + offset, F.lit(0.0))).otherwise(0.0)


def elog(x: Column) -> Column:
    """x ln x, and 0 outside (0, 1)."""
    return F.when((x <= 0) | (x >= 1), 0.0).otherwise(x * F.log(x))


def finite_or_zero(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def radial_basis(x: Column, center: float, width: float) -> Column:
    """exp(-(x - c)^2 / width); the width is neither squared nor doubled."""
    return F.exp(-F.pow(x - center, F.lit(2.0)) / width)


def cubic_terms(x: Column, knots: list[float]) -> list[Column]:
    """x, x^2, x^3 and (x - knot)^3 above each knot."""
    return [x, x * x, x * x * x, *[F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0)) for k in knots]]


def natural_terms(x: Column, knots: list[float]) -> list[Column]:
    """Natural cubic basis: x and the truncated cubes' differences, linear beyond the outer knots."""
    last = knots[-1]

    def cube(k: float) -> Column:
        return (F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0)) - F.pow(F.greatest(x - last, F.lit(0.0)), F.lit(3.0))) / (last - k)

    return [x, *[cube(k) - cube(knots[-2]) for k in knots[:-2]]]


def gaussian_window(n: int, nstd: float) -> list[float]:
    """Gaussian of deviation n / nstd with area 1; one longer than n if n is even."""
    size = n + 1 - n % 2
    half, sd = (size - 1) // 2, n / nstd
    raw = [math.exp(-((i - half) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi)) for i in range(size)]
    total = sum(raw)
    return [v / total for v in raw]


def frequency_bands(start: float, stop: float, bands: int, kind: str = "log") -> list[int]:
    """``bands`` edges from start to stop, spaced evenly ('lin') or by ratio ('log'), cut to whole numbers."""
    if kind not in ("log", "lin"):
        raise ValueError(kind)
    step = range(bands)
    if kind == "lin":
        return [int(start + (stop - start) * i / (bands - 1)) for i in step]
    a, b = math.log10(start), math.log10(stop)
    return [int(10 ** (a + (b - a) * i / (bands - 1))) for i in step]


def as_vectors(values: Column) -> Column:
    """Every scalar of an array as an array of one."""
    return F.transform(values, lambda v: F.array(v))


def zip_vectors(a: Column, b: Column) -> Column:
    """Two arrays of arrays, joined place by place."""
    return F.zip_with(a, b, lambda p, q: F.concat(p, q))

"""Empirical mode decomposition of one or several channels."""

from __future__ import annotations

import math

import numpy as np

from tessitura.functions import kernels as K


def extrema(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima, maxima): strict, ends excluded."""
    lo = np.flatnonzero((x[1:-1] < x[:-2]) & (x[1:-1] < x[2:])) + 1
    hi = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1
    return lo, hi


def mirrored_envelope(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Cubic spline through extrema, with the outer ones mirrored beyond both ends."""
    left, right = -at[:2][::-1], 2 * (n - 1) - at[-2:][::-1]
    x = np.concatenate([left, at, right]).astype(float)
    y = np.concatenate([values[:2][::-1], values, values[-2:][::-1]])
    keep = np.concatenate([[True], np.diff(x) > 0])
    return K.cubic_spline(x[keep], y[keep], np.arange(n))


def mean_envelope(x: np.ndarray) -> np.ndarray | None:
    """Mean of the upper and lower envelopes; None with too few extrema."""
    lo, hi = extrema(x)
    if len(lo) < 2 or len(hi) < 2:
        return None
    return (mirrored_envelope(lo, x[lo], len(x)) + mirrored_envelope(hi, x[hi], len(x))) / 2


def imf(x: np.ndarray, mean_tol: float = 1e-3, steady: int = 3, most: int = 100) -> np.ndarray | None:
    """One intrinsic mode by sifting: until the mean envelope is small, or extrema and zero crossings agree ``steady`` times."""
    h, calm, before = np.array(x, float), 0, None
    if mean_envelope(h) is None:
        return None
    for _ in range(most):
        m = mean_envelope(h)
        if m is None:
            break
        h = h - m
        lo, hi = extrema(h)
        counts = (len(lo) + len(hi), int((np.diff(np.sign(h)) != 0).sum()))
        calm = calm + 1 if counts == before and abs(counts[0] - counts[1]) <= 1 else 0
        before = counts
        if np.abs(m).mean() < mean_tol * max(np.abs(h).mean(), 1e-300) or calm >= steady:
            break
    return h


def emd(x: np.ndarray, most_modes: int = 30, tol: float = 1e-3, **sift) -> list[np.ndarray]:
    """Modes of a signal, then what is left; their sum is the signal."""
    rest, modes = np.array(x, float), []
    while len(modes) < most_modes and np.abs(rest).sum() > tol:
        mode = imf(rest, **sift)
        if mode is None:
            break
        modes.append(mode)
        rest = rest - mode
    return [*modes, rest]


def ensemble(x: np.ndarray, samples: int = 10, gain: float = 0.2, seed: int = 0, **options) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of the modes over noisy copies, by running updates; deviation is sqrt(M2 / (n - 1))."""
    rng = np.random.default_rng(seed)
    width = 0
    mean = m2 = np.zeros((0, len(x)))
    for n in range(1, samples + 1):
        modes = np.array(emd(x + gain * x.std() * rng.normal(size=len(x)), **options)[:-1])
        if len(modes) > width:
            grow = ((0, len(modes) - width), (0, 0))
            mean, m2, width = np.pad(mean, grow), np.pad(m2, grow), len(modes)
        modes = np.pad(modes, ((0, width - len(modes)), (0, 0)))
        step = modes - mean
        mean = mean + step / n
        m2 = m2 + step * (modes - mean)
    return mean, np.sqrt(m2 / max(samples - 1, 1))


def normalized_hilbert(x: np.ndarray, rate: float, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(amplitude, phase, frequency in rad/s): divide by the envelope of maxima until it is 1, then take the arc cosine."""
    fm, amp = np.array(x, float), np.ones(len(x))
    for _ in range(rounds):
        a = np.abs(fm)
        at = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] >= a[2:])) + 1
        if len(at) < 2:
            break
        env = np.maximum(mirrored_envelope(at, a[at], len(x)), 1e-12)
        fm, amp = fm / env, amp * env
        if np.abs(fm).max() <= 1 + 1e-6:
            break
    phase = np.arccos(np.clip(fm, -1, 1))
    return amp, phase, np.concatenate([[0.0], np.diff(phase)]) * rate


def _directions(channels: int, count: int) -> np.ndarray:
    from tessitura.sources.generators import quasirand

    return quasirand(channels, count, spherical=True) if channels > 1 else np.ones((1, 1))


def multi_mean_envelope(s: np.ndarray, directions: np.ndarray) -> np.ndarray | None:
    """Mean over directions of the spline through the channels at the maxima of the projection; None if no direction has enough."""
    total, used = np.zeros_like(s), 0
    for d in directions:
        lo, hi = extrema(d @ s)
        if len(lo) < 2 or len(hi) < 2:
            continue
        for at in (lo, hi):
            total += np.stack([mirrored_envelope(at, c[at], s.shape[1]) for c in s])
        used += 2
    return total / used if used else None


def _damping(h: np.ndarray, m: np.ndarray) -> float:
    """Share of the mean envelope to subtract: the mean over channels of their correlation with it, 0.01 at least each."""
    a, b = h - h.mean(axis=1, keepdims=True), m - m.mean(axis=1, keepdims=True)
    size = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
    return float(np.maximum(np.where(size > 0, (a * b).sum(axis=1) / np.maximum(size, 1e-300), 0), 1e-2).mean())


def memd(s: np.ndarray, modes: int, directions: int = 16, most: int = 10, resolution: float = 50.0, noise_channels: int = 0, seed: int = 0) -> np.ndarray:
    """(modes + 1, channels, times): multichannel modes and the rest; noise channels help alignment and are dropped.

    A sift subtracts a damped mean envelope, until log10 of the first energy over the running mean of the envelopes' energies
    passes ``resolution``, or ``most`` times.
    """
    own = len(s)
    if noise_channels:
        s = np.concatenate([s, np.random.default_rng(seed).normal(0, s.std(), (noise_channels, s.shape[1]))])
    dirs, rest, out = _directions(len(s), directions), np.array(s, float), []
    for _ in range(modes):
        h, energy, mean_energy = rest.copy(), (rest**2).mean(), 0.0
        for i in range(1, most + 1):
            m = multi_mean_envelope(h, dirs)
            if m is None:
                break
            mean_energy += ((m**2).mean() - mean_energy) / i
            h = h - _damping(h, m) * m
            if mean_energy <= 0 or math.log10(max(energy, 1e-300) / mean_energy) > resolution:
                break
        out.append(h)
        rest = rest - h
    return np.array([*out, rest])[:, :own]

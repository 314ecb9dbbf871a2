"""NumPy kernels on one signal: filters, tapers, transforms, splines, linear prediction, small solvers."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np

# --- filters --------------------------------------------------------------------------------------------------------


def butter_zpk(order: int, cut: float | tuple[float, float], kind: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a digital Butterworth filter; cut is a share of the Nyquist frequency (two for a band)."""
    warped = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / 2)
    m = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * m + order - 1) / (2 * order))
    if kind == "low":
        p, z, gain = poles * warped[0], np.zeros(0), warped[0] ** order
    elif kind == "high":
        p, z, gain = warped[0] / poles, np.zeros(order), 1.0
    else:
        width, center = warped[1] - warped[0], warped[0] * warped[1]
        half = poles * width / 2
        root = np.sqrt(half * half - center + 0j)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    gain = float(gain * np.real(np.prod(4 - z) / np.prod(4 - p)))
    zd = np.concatenate([(4 + z) / (4 - z), -np.ones(len(p) - len(z))])
    return zd, (4 + p) / (4 - p), gain


def butter_sos(order: int, cut: float | tuple[float, float], kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth filter."""
    z, p, gain = butter_zpk(order, cut, kind)
    upper = sorted((x for x in p if x.imag > 1e-12), key=lambda x: -abs(x))
    real = sorted((x.real for x in p if abs(x.imag) <= 1e-12), key=abs)
    pairs = [np.real(np.poly([x, np.conj(x)])) for x in upper]
    while real:
        pairs.append(np.poly(real[:2]) if len(real) > 1 else np.array([1.0, -real[0], 0.0]))
        real = real[2:]
    zeros = sorted(np.real(z).tolist())
    if kind == "band":  # a zero at 1 with one at -1 in each section keeps the sections' gains even
        zeros = [v for pair in zip(zeros[: len(zeros) // 2], zeros[len(zeros) // 2 :], strict=False) for v in pair]
    sections = []
    for a in pairs:
        own, zeros = zeros[:2], zeros[2:]
        b = np.poly(own) if own else np.array([1.0])
        sections.append(np.concatenate([b, np.zeros(3 - len(b)), a]))
    out = np.array(sections)
    out[0, :3] *= gain
    return out


#: Samples that a filter section takes at once.
BLOCK = 256


def _section(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One second-order section over all of ``x`` from a state, block by block.

    In state-space form a block's output is a triangular Toeplitz matrix of the impulse response times its input, plus the
    response to the state at its start; the next state is linear in both, so only states pass from block to block.
    """
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    drive = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    size = min(BLOCK, max(1, len(x)))
    powers = np.empty((size + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(size):
        powers[i + 1] = step @ powers[i]
    free = powers[:size, 0, :]  # output at each place of a block for each part of the state
    impulse = np.concatenate([[b[0]], powers[: size - 1, 0, :] @ drive])
    lag = np.arange(size)[:, None] - np.arange(size)[None]
    forced = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    carry = (powers[:size] @ drive)[::-1].T  # next state from a block's input
    out = np.empty(len(x))
    whole = len(x) // size
    inputs = x[: whole * size].reshape(whole, size)
    pushes, settled = inputs @ carry.T, powers[size]
    starts = np.empty((whole, 2))
    for i in range(whole):
        starts[i] = state
        state = settled @ state + pushes[i]
    out[: whole * size] = (inputs @ forced.T + starts @ free.T).ravel()
    rest = x[whole * size :]
    out[whole * size :] = forced[: len(rest), : len(rest)] @ rest + free[: len(rest)] @ state
    return out


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """A cascade of second-order sections (b0 b1 b2 1 a1 a2) over a signal, from a state for each (0 if none is given)."""
    y = np.array(x, float)
    for i, section in enumerate(sos):
        y = _section(section[:3], section[3:], y, np.zeros(2) if state is None else state[i])
    return y


def sos_steady(sos: np.ndarray) -> np.ndarray:
    """States of the sections for a constant input of 1."""
    scale, out = 1.0, np.zeros((len(sos), 2))
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        s2 = b2 - a2 * gain
        out[i] = scale * np.array([b1 - a1 * gain + s2, s2])
        scale *= gain
    return out


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension at the ends."""
    x = np.asarray(x, float)
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad = min(3 * int(taps), len(x) - 1)
    if len(x) < 2:
        return x.copy()
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    steady = sos_steady(sos)
    y = sos_filter(sos, ext, steady * ext[0])[::-1]
    y = sos_filter(sos, y, steady * y[0])[::-1]
    return y[pad : pad + len(x)]


def _rescaled(y: np.ndarray, x: np.ndarray, rescale: bool) -> np.ndarray:
    return y * (np.max(x) / np.max(y)) if rescale and np.max(y) else y


def lowpass(x, rate: float, cut: float, order: int = 5, rescale: bool = False) -> np.ndarray:
    """Zero-phase Butterworth low-pass; ``rescale`` restores the largest value."""
    return _rescaled(zero_phase(butter_sos(order, 2 * cut / rate, "low"), x), x, rescale)


def highpass(x, rate: float, cut: float, order: int = 5, rescale: bool = False) -> np.ndarray:
    return _rescaled(zero_phase(butter_sos(order, 2 * cut / rate, "high"), x), x, rescale)


def bandpass(x, rate: float, low: float, high: float, order: int = 5, rescale: bool = False) -> np.ndarray:
    return _rescaled(zero_phase(butter_sos(order, (2 * low / rate, 2 * high / rate), "band"), x), x, rescale)


def fir_bandpass(x: np.ndarray, rate: float, low: float, high: float, taps: int = 1023) -> np.ndarray:
    """Zero-phase Hamming FIR band-pass (applied twice); short signals are returned as they are."""
    if len(x) < taps + 1:
        return np.asarray(x, float)
    n = np.arange(taps) - (taps - 1) / 2
    h = (2 * high / rate * np.sinc(2 * high / rate * n) - 2 * low / rate * np.sinc(2 * low / rate * n)) * np.hamming(taps)
    h /= abs(np.sum(h * np.exp(-1j * np.pi * (low + high) / rate * n)))
    size = fast_length(len(x) + 2 * taps)
    gain = np.abs(np.fft.rfft(h, size)) ** 2
    return np.fft.irfft(np.fft.rfft(x, size) * gain, size)[: len(x)]


# --- windows and transforms -----------------------------------------------------------------------------------------


def fast_length(n: int) -> int:
    """The least 5-smooth number of at least n."""
    best = 1 << max(n - 1, 0).bit_length()
    f5 = 1
    while f5 < best:
        f35 = f5
        while f35 < best:
            best = min(best, f35 * (1 << max(-(-n // f35) - 1, 0).bit_length()))
            f35 *= 3
        f5 *= 5
    return best


def hann(n: int) -> np.ndarray:
    return np.hanning(n)


def gaussian(n: int, nstd: float) -> np.ndarray:
    """Gaussian of deviation n / nstd and area 1; one longer than n if n is even."""
    size = n + 1 - n % 2
    t = np.arange(size) - (size - 1) // 2
    w = np.exp(-(t**2) / (2 * (n / nstd) ** 2))
    return w / w.sum()


def dpss(n: int, nw: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k Slepian tapers (rows, unit energy) and their concentrations; even tapers have positive sums, odd ones start upwards."""
    t = np.arange(n)
    diag = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * nw / n)
    off = t[1:] * (n - t[1:]) / 2
    matrix = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    _, vectors = np.linalg.eigh(matrix)
    tapers = vectors[:, ::-1][:, :k].T
    for i, w in enumerate(tapers):
        if (w.sum() if i % 2 == 0 else w[np.argmax(np.abs(w) > 1e-3 * np.abs(w).max())]) < 0:
            tapers[i] = -w
    lags = np.arange(1, n)
    kernel = np.concatenate([[2 * nw / n], 2 * np.sin(2 * np.pi * nw / n * lags) / (np.pi * lags)])
    auto = np.array([np.correlate(w, w, "full")[n - 1 :] for w in tapers])
    return tapers, auto @ kernel


def detrend(x: np.ndarray) -> np.ndarray:
    """x less its least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    slope = (t @ x) / max(t @ t, 1e-300)
    return x - x.mean() - slope * t


def resample(x: np.ndarray, size: int) -> np.ndarray:
    """Fourier resampling to ``size`` samples."""
    n = len(x)
    spec = np.fft.rfft(x)
    out = np.zeros(size // 2 + 1, complex)
    keep = min(n, size) // 2 + 1
    out[:keep] = spec[:keep]
    if min(n, size) % 2 == 0 and n != size:
        out[keep - 1] *= 0.5 if size > n else 2
    return np.fft.irfft(out, size) * size / n


def analytic(x: np.ndarray, standard: bool = True) -> np.ndarray:
    """Analytic signal; ``standard`` keeps DC and Nyquist once, else every frequency from 0 up counts twice."""
    n = len(x)
    spec, gain = np.fft.fft(x), np.zeros(n)
    gain[np.fft.fftfreq(n) >= 0] = 2
    if standard:
        gain[0] = 1
        if n % 2 == 0:
            gain[n // 2] = 1
    return np.fft.ifft(spec * gain)


def dct2(x: np.ndarray) -> np.ndarray:
    """Orthonormal DCT-II."""
    n = len(x)
    spec = np.fft.fft(np.concatenate([x, x[::-1]]))[:n]
    out = np.real(spec * np.exp(-1j * np.pi * np.arange(n) / (2 * n))) / np.sqrt(2 * n)
    out[0] /= np.sqrt(2)
    return out


def welch(x: np.ndarray, rate: float, size: int = 1024, overlap: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(freqs, density): one-sided Welch spectrum with a symmetric Hann window and no detrending."""
    x = np.asarray(x, float)
    x = np.pad(x, (0, max(0, size - len(x))))
    w = np.hanning(size)
    starts = range(0, len(x) - size + 1, size - overlap)
    spec = np.mean([np.abs(np.fft.rfft(x[s : s + size] * w)) ** 2 for s in starts], axis=0) / (rate * (w**2).sum())
    spec[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / rate), spec


def correlation(a: np.ndarray, b: np.ndarray, lags: np.ndarray, center: bool = True, normalize: bool = True) -> np.ndarray:
    """sum a[t] b[t + lag] over N - |lag|, as the relational operator computes it."""
    scale = a.std(ddof=1) * b.std(ddof=1) if normalize else 1.0
    if center:
        a, b = a - a.mean(), b - b.mean()
    n = len(a)
    size = fast_length(2 * n)
    full = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
    return full[np.asarray(lags) % size] / (n - np.abs(lags)) / (scale or 1.0)


# --- short-time spectra ---------------------------------------------------------------------------------------------


def frames(x: np.ndarray, rate: float, window: float, hop: float) -> np.ndarray:
    """Frames of odd length centred on every hop, zeros outside: ceil(N / hop) rows."""
    size = int(rate * window)
    size += 1 - size % 2
    half, step = size // 2, max(1, int(rate * hop))
    padded = np.concatenate([np.zeros(half), np.asarray(x, float), np.zeros(half)])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step]


class SpectrumEstimator(Protocol):
    """What ``stft`` asks of an estimator: its frequencies, and spectra of rows of samples, one row a frame."""

    def frequencies(self, size: int, rate: float) -> np.ndarray: ...

    def estimate(self, rows: np.ndarray, rate: float) -> np.ndarray: ...


class GaussianEstimator:
    """Complex spectra of Gaussian-windowed frames, zero-padded to a fast length; frequencies from 0 up."""

    def __init__(self, nstd: float = 6):
        self.nstd = nstd

    def frequencies(self, size: int, rate: float) -> np.ndarray:
        f = np.fft.fftfreq(fast_length(size), 1 / rate)
        return f[f >= 0]

    def estimate(self, rows: np.ndarray, rate: float) -> np.ndarray:
        size = fast_length(rows.shape[1])
        return np.fft.fft(rows * gaussian(rows.shape[1], self.nstd), size)[:, np.fft.fftfreq(size) >= 0]


class MultitaperEstimator:
    """Multitaper power of frames; ``adaptive`` weighs the tapers by Thomson's rule."""

    def __init__(self, bandwidth: float, adaptive: bool = False, most: int = 150):
        self.bandwidth, self.adaptive, self.most = bandwidth, adaptive, most

    def frequencies(self, size: int, rate: float) -> np.ndarray:
        f = np.fft.fftfreq(size, 1 / rate)
        return f[f >= 0]

    def estimate(self, rows: np.ndarray, rate: float) -> np.ndarray:
        n = rows.shape[1]
        nw = max(1, int(n / rate * self.bandwidth))
        tapers, share = dpss(n, nw, 2 * nw - 1)
        keep = np.fft.fftfreq(n) >= 0
        spec = np.abs(np.fft.fft(rows[:, None, :] * tapers[None])[:, :, keep]) ** 2
        if not self.adaptive:
            return spec.mean(axis=1)
        share = np.clip(share, 1e-12, 1 - 1e-12)[None, :, None]
        power = rows.var(axis=1)[:, None, None]
        out = spec[:, :2].mean(axis=1, keepdims=True)
        for _ in range(self.most):
            w = np.sqrt(share) * out / (share * out + (1 - share) * power + 1e-300)
            new = (w**2 * spec).sum(axis=1, keepdims=True) / np.maximum((w**2).sum(axis=1, keepdims=True), 1e-300)
            done = np.abs(new - out).max() <= 1e-8 * np.abs(out).max()
            out = new
            if done:
                break
        return out[:, 0]


    def jackknife(self, rows: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(mean power, deviation) of frames from leaving each taper out."""
        n = rows.shape[1]
        nw = max(1, int(n / rate * self.bandwidth))
        tapers, _ = dpss(n, nw, 2 * nw - 1)
        spec = np.abs(np.fft.fft(rows[:, None, :] * tapers[None])[:, :, np.fft.fftfreq(n) >= 0]) ** 2
        k = spec.shape[1]
        if k < 2:
            return spec[:, 0], np.zeros_like(spec[:, 0])
        out = (spec.sum(axis=1, keepdims=True) - spec) / (k - 1)
        return spec.mean(axis=1), np.sqrt((k - 1) / k * ((out - out.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


class WaveletEstimator:
    """Morlet amplitudes at log2-spaced frequencies, highest first; the longest wavelet sets the window."""

    def __init__(self, cycles: float = 10, low: float = 1, high: float = 512, count: int = 20, nstd: float = 6):
        self.cycles, self.nstd = cycles, nstd
        self.freqs = 2.0 ** np.linspace(np.log2(high), np.log2(low), count)

    def window(self) -> float:
        return self.cycles / self.freqs.min()

    def frequencies(self, size: int, rate: float) -> np.ndarray:
        return self.freqs

    def estimate(self, rows: np.ndarray, rate: float) -> np.ndarray:
        t = (np.arange(rows.shape[1]) - rows.shape[1] // 2) / rate
        sd = self.cycles / (self.nstd * self.freqs)
        bank = np.exp(-(t[None] ** 2) / sd[:, None] ** 2) * np.exp(2j * np.pi * self.freqs[:, None] * t[None]) * np.sqrt(self.freqs)[:, None]
        return rows @ np.conj(bank).T


def stft(x, rate: float, window: float, hop: float, estimator, low: float = 0, high: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, freqs, tf) with tf of shape (freqs, times), frequencies low..high inclusive."""
    rows = frames(x, rate, window, hop)
    f = estimator.frequencies(rows.shape[1], rate)
    keep = (f >= low) & (f <= (rate / 2 if high is None else high))
    t = np.arange(len(rows)) * max(1, int(rate * hop)) / rate
    return t, f[keep], estimator.estimate(rows, rate)[:, keep].T


def spectrogram(x, rate: float, spec_rate: float, spacing: float, low: float = 0, high: float | None = None, nstd: float = 6, cmplx: bool = True):
    """Gaussian STFT whose window follows from the frequency spacing."""
    t, f, tf = stft(x, rate, nstd / (2 * np.pi * spacing), 1 / spec_rate, GaussianEstimator(nstd), low, high)
    return t, f, tf if cmplx else np.abs(tf)


def inverse_spectrogram(tf: np.ndarray, size: int, rate: float, spec_rate: float, spacing: float, low: float = 0, nstd: float = 6, log: bool = False, noise_db: float = 80) -> np.ndarray:
    """Weighted overlap-add of a Gaussian STFT; ``log`` undoes decibels above the noise level first."""
    if log:
        tf = np.where(np.real(tf) > 0, 10 ** ((np.real(tf) - noise_db) / 20), 0)
    n = int(rate * nstd / (2 * np.pi * spacing))
    n += 1 - n % 2
    half, step, w = n // 2, max(1, int(rate / spec_rate)), gaussian(n, nstd)
    fft = fast_length(n)
    f = np.fft.fftfreq(fft, 1 / rate)
    first = int(np.searchsorted(f[f >= 0], low))
    full = np.zeros((tf.shape[1], fft), complex)
    full[:, first : first + tf.shape[0]] = tf.T
    top = fft - np.arange(1, (fft - 1) // 2 + 1)
    full[:, top] = np.conj(full[:, 1 : (fft - 1) // 2 + 1])
    pieces = np.real(np.fft.ifft(full))[:, :n] * w
    out, weight = np.zeros(size + 2 * half + n), np.zeros(size + 2 * half + n)
    for i, p in enumerate(pieces):
        if i * step < size + 2 * half:
            out[i * step : i * step + n] += p
            weight[i * step : i * step + n] += w**2
    return (out / np.maximum(weight, 1e-12))[half : half + size]


def griffin_lim(amplitude: np.ndarray, size: int, rate: float, spec_rate: float, spacing: float, low: float = 0, iterations: int = 10) -> np.ndarray:
    """A signal whose spectrogram has the given amplitudes, by alternating projections."""
    tf = amplitude.astype(complex)
    x = inverse_spectrogram(tf, size, rate, spec_rate, spacing, low)
    for _ in range(iterations):
        _, _, now = spectrogram(x, rate, spec_rate, spacing, low)
        now = now[: tf.shape[0], : tf.shape[1]]
        tf = amplitude[: now.shape[0], : now.shape[1]] * np.exp(1j * np.angle(now))
        x = inverse_spectrogram(tf, size, rate, spec_rate, spacing, low)
    return x


def envelope(x, rate: float, cut: float = 200.0, resample_rate: float | None = None) -> np.ndarray:
    """|x - mean|, low-passed (order 4), never under 0, resampled if asked."""
    x = np.asarray(x, float)
    e = np.maximum(lowpass(np.abs(x - x.mean()), rate, cut, 4), 0)
    return np.maximum(resample(e, int(len(e) / rate * resample_rate)), 0) if resample_rate else e


def band_analytic(x, rate: float, centers: list[float], widths: list[float]) -> np.ndarray:
    """Analytic signals of Gaussian bands in frequency, one row a band; padded to a power of two."""
    n = len(x)
    size = 1 << (n - 1).bit_length()
    spec, f = np.fft.fft(x, size), np.fft.fftfreq(size, 1 / rate)
    gain = np.exp(-((f[None] - np.array(centers)[:, None]) ** 2) / (2 * np.array(widths)[:, None] ** 2)) * np.where(f > 0, 2, np.where(f == 0, 1, 0))
    return np.fft.ifft(spec[None] * gain)[:, :n]


def bandpass_analytic(x, rate: float, edges: list[float], order: int = 5) -> np.ndarray:
    """Analytic signals between sorted edges: a low-pass under the first, band-passes above."""
    edges = sorted(edges)
    rows = [lowpass(x, rate, edges[0], order), *[bandpass(x, rate, a, b, order) for a, b in zip(edges, edges[1:], strict=False)]]
    return np.array([analytic(row) for row in rows])


def modulation_spectrum(spec: np.ndarray, df: float, dt: float, window: float | None = None, normalize: bool = True):
    """(wf, wt, power): average 2-D power spectrum of Gaussian-windowed pieces of a log spectrogram (freqs, times)."""
    s = np.maximum(spec, spec.max() - 50) if normalize else spec
    if normalize:
        s = (s - s.mean()) / (s.std() or 1.0)
    window = window if window is not None else spec.shape[1] * dt / 10
    n = max(3, int(math.ceil(window / dt)))
    n += 1 - n % 2
    half = (n - 1) // 2
    padded = np.pad(s, ((0, 0), (half, half)), constant_values=s.min())
    w = gaussian(n, 6)
    w = w / w.max()
    total, count = 0, 0
    for c in range(0, s.shape[1], max(1, half // 3)):
        total = total + np.abs(np.fft.fft2(padded[:, c : c + n] * w)) ** 2
        count += 1
    wf, wt = np.fft.fftshift(np.fft.fftfreq(s.shape[0], df)), np.fft.fftshift(np.fft.fftfreq(n, dt))
    return wf, wt, np.fft.fftshift(total / count)


def mtfft(spec: np.ndarray, df: float, dt: float, log: bool = False):
    """(wf, wt, power, phase) of the whole spectrogram's shifted 2-D transform."""
    z = np.fft.fftshift(np.fft.fft2(spec))
    power = np.abs(z) ** 2
    return np.fft.fftshift(np.fft.fftfreq(spec.shape[0], df)), np.fft.fftshift(np.fft.fftfreq(spec.shape[1], dt)), 10 * np.log10(power) if log else power, np.angle(z)


def strf_mps(strf: np.ndarray, df: float, rate: float, half: bool = False):
    """Modulation spectrum of a receptive field, time reversed; ``half`` keeps wf >= 0."""
    wf, wt, power, _ = mtfft(strf[:, ::-1], df, 1 / rate)
    return (wf[wf >= 0], wt, power[wf >= 0]) if half else (wf, wt, power)


def surrogates(x: np.ndarray, count: int = 5, seed: int = 0, real: bool = True) -> np.ndarray:
    """Signals with the same power spectrum and shuffled phases; ``real`` keeps them conjugate-symmetric."""
    rng, n = np.random.default_rng(seed), len(x)
    spec = np.fft.rfft(x) if real else np.fft.fft(x)
    out = []
    for _ in range(count):
        phase = np.angle(spec)
        inner = slice(1, (n - 1) // 2 + 1) if real else slice(None)
        phase[inner] = rng.permutation(phase[inner])
        z = np.abs(spec) * np.exp(1j * phase)
        out.append(np.fft.irfft(z, n) if real else np.fft.ifft(z))
    return np.array(out)


# --- splines --------------------------------------------------------------------------------------------------------


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot interpolating cubic through (x, y); a line or parabola through two or three points. y may have columns."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 4:
        return np.stack([np.polyval(np.polyfit(x, col, n - 1), at) for col in y.reshape(n, -1).T], axis=-1).reshape(np.shape(at) + y.shape[1:])
    h = np.diff(x)
    slope = (np.diff(y, axis=0).T / h).T
    a, b, c = np.zeros(n), np.zeros(n), np.zeros(n)
    rhs = np.zeros_like(y)
    a[1:-1], b[1:-1], c[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(slope, axis=0)
    # second derivatives at the ends follow from equal third derivatives across the second and last-but-one knots
    r0, r1 = h[0] / h[1], h[-1] / h[-2]
    b[1] += a[1] * (1 + r0)
    c[1] -= a[1] * r0
    b[-2] += c[-2] * (1 + r1)
    a[-2] -= c[-2] * r1
    m = np.zeros_like(y)
    cp, dp = np.zeros(n), np.zeros_like(y)
    cp[1], dp[1] = c[1] / b[1], rhs[1] / b[1]
    for i in range(2, n - 1):
        den = b[i] - a[i] * cp[i - 1]
        cp[i], dp[i] = c[i] / den, (rhs[i] - a[i] * dp[i - 1]) / den
    for i in range(n - 2, 0, -1):
        m[i] = dp[i] - (cp[i] * m[i + 1] if i < n - 2 else 0)
    m[0], m[-1] = (1 + r0) * m[1] - r0 * m[2], (1 + r1) * m[-2] - r1 * m[-3]
    # each piece as a polynomial of the distance from its left knot
    h = h.reshape(-1, *[1] * (y.ndim - 1))
    parts = (y[:-1], slope - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m, axis=0) / (6 * h))
    at = np.asarray(at)
    if at.ndim == 1 and len(at) > 1 and (at[1:] >= at[:-1]).all():  # rising places fall into the pieces in runs
        runs = np.diff(np.searchsorted(at, x[1:-1], "left"), prepend=0, append=len(at))
        a0, a1, a2, a3, left = (np.repeat(v, runs, axis=0) for v in (*parts, x[:-1]))
    else:
        i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
        a0, a1, a2, a3, left = (v[i] for v in (*parts, x[:-1]))
    u = (at - left).reshape(*at.shape, *[1] * (y.ndim - 1))
    return a0 + u * (a1 + u * (a2 + u * a3))


def resample_grid(t: np.ndarray, f: np.ndarray, spec: np.ndarray, dt: float, df: float):
    """Tensor cubic spline of a spectrogram (freqs, times) on a grid from 0 with new spacings."""
    nt, nf = np.arange(0, t[-1] + dt / 2, dt), np.arange(0, f[-1] + df / 2, df)
    return nt, nf, cubic_spline(t, cubic_spline(f, spec, nf).T, nt).T


# --- linear prediction, peaks, special functions --------------------------------------------------------------------


def lpc(x: np.ndarray, order: int) -> np.ndarray:
    """Autocorrelation method: [1, a1, ..., a_order] of the prediction error filter."""
    r = np.correlate(x, x, "full")[len(x) - 1 : len(x) + order]
    if r[0] == 0:
        return np.concatenate([[1.0], np.zeros(order)])
    toeplitz = r[np.abs(np.arange(order)[:, None] - np.arange(order)[None])]
    return np.concatenate([[1.0], -np.linalg.lstsq(toeplitz, r[1:], rcond=None)[0]])


def lpc_burg(x: np.ndarray, order: int) -> np.ndarray:
    """Burg's method."""
    f, b, a = np.asarray(x, float)[1:], np.asarray(x, float)[:-1], np.array([1.0])
    for _ in range(order):
        den = f @ f + b @ b
        k = -2 * (f @ b) / den if den > 0 else 0.0
        a = np.concatenate([a, [0.0]]) + k * np.concatenate([a, [0.0]])[::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def peaks(x: np.ndarray, least: float | None = None, distance: int = 1) -> np.ndarray:
    """Rising-edge local maxima, thinned by falling height."""
    if len(x) < 3:
        return np.zeros(0, int)
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[2:] <= x[1:-1])) + 1
    if least is not None:
        at = at[x[at] >= least]
    kept: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")]:
        if all(abs(i - k) > distance for k in kept) or distance <= 1:
            kept.append(i)
    return np.array(sorted(kept), int)


def digamma(x) -> np.ndarray:
    """Digamma of positive numbers: recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i2 = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial, from log terms."""
    if k <= 0:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(terms, default=-math.inf)
    return math.exp(top) * sum(math.exp(t - top) for t in terms) if terms else 0.0


def elastic_net(gram: np.ndarray, xty: np.ndarray, l1: float, l2: float, positive: bool = False, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent for 1/2 |y - Xw|^2 + l1 |w|_1 + l2/2 |w|^2 from X'X and X'y alone."""
    w = np.zeros(len(xty))
    for _ in range(rounds):
        move = 0.0
        for j in range(len(w)):
            if gram[j, j] + l2 == 0:
                continue
            rest = xty[j] - gram[j] @ w + gram[j, j] * w[j]
            new = max(rest - l1, 0.0) if rest > 0 or positive else -max(-rest - l1, 0.0)
            new /= gram[j, j] + l2
            move, w[j] = max(move, abs(new - w[j])), new
        if move < tol * max(1.0, np.abs(w).max()):
            break
    return w


def least_squares(f, start: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Levenberg-Marquardt with forward differences, for few parameters."""
    p, damp = np.array(start, float), 1e-3
    r = f(p)
    for _ in range(rounds):
        steps = 1e-6 * np.maximum(np.abs(p), 1e-3)
        jac = np.array([(f(p + np.eye(len(p))[i] * s) - r) / s for i, s in enumerate(steps)]).T
        a, g = jac.T @ jac, jac.T @ r
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        new = f(p + step)
        if new @ new < r @ r:
            gain = (r @ r - new @ new) / max(r @ r, 1e-300)
            p, r, damp = p + step, new, damp / 3
            if gain < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p

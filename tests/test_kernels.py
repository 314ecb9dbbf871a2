"""Kernels against closed forms and naive versions."""

import math

import numpy as np
import pytest

from tessitura.functions import emd_kernels as E
from tessitura.functions import kernels as K
from tessitura.functions import learn_kernels as L
from tessitura.functions import sound_kernels as V
from tessitura.sources import generators as G
from tessitura.sources import wav

T = np.arange(2000) / 1000
LOW, HIGH = np.sin(2 * np.pi * 25 * T), np.sin(2 * np.pi * 200 * T)


@pytest.mark.parametrize(("f", "want"), [(lambda x: K.lowpass(x, 1000, 60), LOW), (lambda x: K.highpass(x, 1000, 100), HIGH), (lambda x: K.bandpass(x, 1000, 150, 250), HIGH)])
def test_filters_keep_their_band(f, want):
    assert np.abs(f(LOW + HIGH) - want)[200:-200].max() < 1e-3


def test_butterworth_halves_power_at_the_cut():
    sos = K.butter_sos(5, 0.2, "low")
    z = np.exp(1j * np.pi * 0.2)
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (a0 + a1 / z + a2 / z**2) for b0, b1, b2, a0, a1, a2 in sos])
    assert abs(abs(h) - math.sqrt(0.5)) < 1e-9


def test_tapers_are_orthonormal_and_concentrated():
    w, share = K.dpss(256, 3, 5)
    assert np.allclose(w @ w.T, np.eye(5), atol=1e-8)
    assert share[0] > 0.99999 and (np.diff(share) < 0).all()


def test_fast_length_is_least_smooth():
    def smooth(n):
        for p in (2, 3, 5):
            while n % p == 0:
                n //= p
        return n == 1

    for n in (1, 7, 97, 1001, 4097):
        assert K.fast_length(n) == next(m for m in range(n, 2 * n + 2) if smooth(m))


def test_spline_is_exact_for_cubics():
    x, at = np.linspace(0, 5, 9), np.linspace(0, 5, 40)
    assert np.allclose(K.cubic_spline(x, x**3 - x, at), at**3 - at)
    assert np.allclose(K.cubic_spline(x[:3], x[:3] ** 2, at[:5]), at[:5] ** 2)


def test_spectrogram_inverts():
    _, _, s = K.spectrogram(LOW + HIGH, 1000, 100, 10)
    assert np.abs(K.inverse_spectrogram(s, 2000, 1000, 100, 10) - LOW - HIGH)[100:-100].max() < 1e-3


def test_stft_has_a_frame_per_hop_and_the_right_ridge():
    t, f, s = K.stft(LOW, 1000, 0.2, 0.01, K.GaussianEstimator())
    assert len(t) == 200
    assert abs(f[np.abs(s[:, 100]).argmax()] - 25) < 5
    for est in (K.MultitaperEstimator(20), K.MultitaperEstimator(20, adaptive=True)):
        _, f, p = K.stft(LOW, 1000, 0.2, 0.01, est)
        assert abs(f[p[:, 100].argmax()] - 25) < 20


def test_resample_and_analytic():
    assert np.allclose(K.resample(K.resample(LOW, 4000), 2000), LOW)
    assert np.allclose(np.abs(K.analytic(HIGH))[100:-100], 1, atol=1e-6)
    assert np.allclose(np.real(K.analytic(HIGH)), HIGH)


def test_surrogates_keep_the_spectrum():
    x = LOW + 0.3 * np.random.default_rng(0).normal(size=2000)
    for s in K.surrogates(x, 3):
        assert np.allclose(np.abs(np.fft.rfft(s)), np.abs(np.fft.rfft(x)), atol=1e-3)


def test_linear_prediction_finds_an_autoregression():
    rng, x = np.random.default_rng(1), np.zeros(20000)
    for i in range(2, len(x)):
        x[i] = 1.2 * x[i - 1] - 0.6 * x[i - 2] + rng.normal()
    for a in (K.lpc(x, 2), K.lpc_burg(x, 2)):
        assert np.allclose(a, [1, -1.2, 0.6], atol=0.02)


def test_special_functions():
    assert np.allclose(K.digamma([1.0, 2.0, 30.0]), [-0.5772156649, 0.4227843351, 3.384438136], atol=1e-7)
    assert abs(K.binomial_tail(3, 5, 0.5) - 0.5) < 1e-12


@pytest.mark.parametrize("method", ["AC", "HPS", "Stack"])
def test_pitch_of_a_stack(method):
    rate, f0 = 16000, 500
    t = np.arange(8000) / rate
    x = sum(np.sin(2 * np.pi * k * f0 * t) / k for k in range(1, 8))
    track = V.fundamental(x, rate, method, hop=0.02)
    assert abs(np.nanmedian(track["f0"]) - f0) < 0.02 * f0


def test_features_handle_silence():
    f = V.features(np.zeros(3000), 16000)
    assert math.isnan(f["fund"]) and math.isnan(f["meanspect"])


def test_modes_add_up():
    x = np.sin(2 * np.pi * 5 * T) + np.sin(2 * np.pi * 35 * T)
    modes = E.emd(x)
    assert len(modes) > 1 and np.allclose(sum(modes), x) and abs(modes[0].mean()) < 1e-2
    s = np.array([LOW + np.sin(2 * np.pi * 2 * T), LOW])
    assert np.allclose(E.memd(s, 2, 4, 3).sum(axis=0), s)


def test_gradient_matches_differences_and_descent_recovers():
    rng = np.random.default_rng(2)
    x = np.hstack([rng.normal(size=(400, 6)), np.ones((400, 1))])
    w = np.array([1.0, 0, 0, -2, 0, 0.5, -1.5])
    m = L.ConvolutionModel(x.T @ x, x.T @ (x @ w), float((x @ w) @ (x @ w)), 400)
    at = rng.normal(size=7)
    assert np.allclose(m.gradient(at), L.difference_gradient(m.error, at, 1e-6), rtol=1e-3, atol=1e-2)
    assert np.allclose(L.threshold_descent(m, np.zeros(7), 1e-3, 0.0, 5000, normalize=False, slope=1), w, atol=1e-3)
    found = L.in_crowd(m, 1e-3)
    assert np.allclose(found, w, atol=1e-3)


def test_information_of_gaussians():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 1))
    y = 0.8 * x + 0.6 * rng.normal(size=(1500, 1))
    assert abs(L.knn_mi(x, y) + 0.5 * math.log2(1 - 0.64)) < 0.15
    assert abs(L.knn_entropy(x) - 0.5 * math.log2(2 * math.pi * math.e)) < 0.1
    assert abs(L.knn_cmi(x, y, rng.normal(size=(1500, 1))) - L.knn_mi(x, y)) < 0.2
    assert L.knn_kl(x, x[:700] + 3) > 1


def test_quasirandom_points():
    p = G.quasirand(2, 1000)
    assert p.shape == (1000, 2) and p.min() >= 0 and p.max() < 1 and np.abs(p.mean(axis=0) - 0.5).max() < 0.01
    assert np.allclose((G.quasirand(3, 1000, True) ** 2).sum(axis=1), 1, atol=1e-6)


def test_wav_round_trip():
    rate, channels = wav.parse_wav(wav.format_wav(LOW, 8000, True))
    assert rate == 8000 and np.abs(np.array(channels[0]) - np.trunc(LOW / np.abs(LOW).max() * 32767)).max() == 0
    with pytest.raises(ValueError):
        wav.parse_wav(b"nothing")


def test_complex_components_invert_and_demodulation_stills_phase():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(300, 3)) + 1j * rng.normal(size=(300, 3))
    values, vectors = L.complex_pca(np.conj(z.T @ np.conj(z)) / 300)
    assert np.allclose(L.complex_inverse(L.complex_transform(z, vectors), vectors), z)
    assert (np.diff(np.abs(values)) <= 1e-12).all()
    wave = np.exp(2j * np.pi * 5 * T)
    out = L.demodulate(np.array([wave, 0.5 * wave]))
    assert np.abs(np.diff(np.unwrap(np.angle(out[0])))).max() < 0.01


@pytest.mark.parametrize("size", [1, 5, 255, 256, 257, 1000])
def test_blocked_filter_equals_the_recursion(size):
    rng = np.random.default_rng(size)
    sos, x = K.butter_sos(5, (0.1, 0.3), "band"), rng.normal(size=size)
    state = rng.normal(size=(len(sos), 2))
    want = x.tolist()
    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sos, state, strict=True):
        out = []
        for v in want:
            w = b0 * v + s1
            s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
            out.append(w)
        want = out
    assert np.allclose(K.sos_filter(sos, x, state), want, rtol=1e-9, atol=1e-10)


def test_wav_formats():
    """24-bit samples, and the extensible header."""
    import struct

    values = [0, 1, -1, 8388607, -8388608, 70000]
    body = b"".join(struct.pack("<i", v)[:3] for v in values)
    for tag, extra in ((1, b""), (0xFFFE, struct.pack("<HHIH", 22, 24, 0, 1) + b"\0" * 14)):
        fmt = struct.pack("<HHIIHH", tag, 2, 8000, 48000, 6, 24) + extra
        data = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body
        assert wav.parse_wav(data) == (8000, [[float(v) for v in values[::2]], [float(v) for v in values[1::2]]])
        assert wav.parse_wav(data, True)[1] == [[float(v) for v in values[::2]]]

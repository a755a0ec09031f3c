"""Signal kernels and event families against slow versions written from the definitions."""

import math

import numpy as np
import pytest

from callgrid.functions import features as X
from callgrid.functions import kernels as K

R = np.random.default_rng(21)


def dft(x, n):
    """One-sided transform of n points, term by term."""
    return np.array([sum(v * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i, v in enumerate(x[:n]))
        for k in range(n // 2 + 1)])


def test_spectrum_is_the_transform_of_each_frame():
    x, w = R.normal(size=50), K.hann(16)
    got = K.spectrum(x, w, 4)
    frames = [x[i : i + 16] * w for i in range(0, 50 - 16 + 1, 4)]
    assert got.shape == (9, len(frames))
    for j, f in enumerate(frames):
        assert np.allclose(got[:, j], dft(f, 16))
    assert K.spectrum(x, w, 4, tail=True).shape[1] == len(frames) + 1


def test_centred_power_mirrors_its_ends():
    x = R.normal(size=40)
    got = K.centred_power(x, 16, 12, 5)
    padded = np.concatenate([x[8:0:-1], x, x[-2:-10:-1]])
    window = np.concatenate([[0, 0], 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(12) / 12), [0, 0]])
    for j in range(got.shape[1]):
        assert np.allclose(got[:, j], np.abs(dft(padded[5 * j : 5 * j + 16] * window, 16)) ** 2)


def test_mel_bank_and_centres():
    bank, f = K.mel_bank(10, 64, 250.0, 5.0, 110.0), np.arange(33) * 250 / 64
    points = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(2595 * math.log10(1 + 5 / 700), 2595 * math.log10(1 + 110 / 700), 12)]
    for i in range(10):
        a, b, c = points[i : i + 3]
        for j, v in enumerate(f):
            want = (v - a) / (b - a) if a <= v <= b else (c - v) / (c - b) if b <= v <= c else 0.0
            assert abs(bank[i, j] - want) < 1e-12
    mels = [2595 * math.log10(1 + p / 700) for p in points]
    assert np.allclose(K.mel_centres(10, 5.0, 110.0), [700 * (10 ** (sum(mels[i : i + 3]) / 3 / 2595) - 1) for i in range(10)])


def test_cosine_transform_is_orthonormal():
    x = R.normal(size=(9, 4))
    got = K.cosine_transform(x)
    for k in range(9):
        scale = math.sqrt(1 / 9) if k == 0 else math.sqrt(2 / 9)
        assert np.allclose(got[k], [scale * sum(x[i, j] * math.cos(math.pi * k * (2 * i + 1) / 18) for i in range(9)) for j in range(4)])
    assert np.allclose((got**2).sum(), (x**2).sum())


@pytest.mark.parametrize("n", [1, 2, 7, 16])
def test_envelope_from_the_analytic_signal(n):
    x = R.normal(size=n)
    whole = [sum(x[i] * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i in range(n)) for k in range(n)]
    keep = [1 if k == 0 or 2 * k == n else 2 if 2 * k < n else 0 for k in range(n)]
    analytic = [sum(h * s * complex(math.cos(2 * math.pi * k * i / n), math.sin(2 * math.pi * k * i / n)) for k, (h, s) in enumerate(zip(keep, whole,
        strict=True))) / n for i in range(n)]
    assert np.allclose(K.envelope(x), np.abs(analytic))


def test_resize_by_hand():
    image = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert np.allclose(K.resize(image, 2, 2), image)
    assert np.allclose(K.resize(image, 1, 1), [[1.5]])
    assert np.allclose(K.resize(image, 2, 4), [[0, 0.25, 0.75, 1], [2, 2.25, 2.75, 3]])


def test_resample_keeps_a_tone():
    t = np.arange(2000) / 1000
    got = K.resample(np.sin(2 * np.pi * 20 * t), 1000, 250)
    want = np.sin(2 * np.pi * 20 * np.arange(500) / 250)
    assert len(got) == 500 and np.abs(got - want)[20:-20].max() < 0.01


@pytest.mark.parametrize("x, peaks", [([0, 9, 0, 0, 0], 1), ([0, 9, 9, 0, 0, 0], 1), ([9, 0, 0, 0, 9], 0), ([0, 9, 0, 8, 0, 1, 0, 0], 2), ([1, 1], 0)])
def test_peaks(x, peaks):
    assert K.peak_count(np.array(x, float)) == peaks


def test_descriptors_of_a_tone():
    e = X.Event({"clip_start_seconds": 0.0, "clip_end_seconds": 4.0, "low_frequency": 20.0, "high_frequency": 60.0, "duration_seconds": 4.0},
        np.sin(2 * np.pi * 40 * np.arange(1000) / 250), 250)
    cfg = {"sample_rate": 250, "n_fft": 64, "win_length": 64, "hop_length": 16, "n_mels": 32, "f_min": 0, "f_max": 125, "frequency_scale": "linear",
        "normalization": "sample"}
    d = dict(zip(X.feature_names("spectral_stats"), X.vector(e, cfg, "spectral_stats"), strict=True))
    assert abs(d["dominant_frequency_hz_mean"] - 40) < 4 and abs(d["spectral_centroid_hz_mean"] - 40) < 4 and d["frequency_of_max_energy_hz"] == d["dominant_frequency_hz_max"]
    box = dict(zip(X.CROP, X.vector(e, cfg, X.representation("handcrafted")), strict=True))
    values, f, t = X.boxed(e, cfg)
    assert f.min() >= 20 and f.max() <= 60 and abs(box["spectral_centroid_hz"] - (f * values.sum(1)).sum() / values.sum()) < 1e-3
    assert abs(box["low_half_energy_ratio"] + box["high_half_energy_ratio"] - 1) < 1e-6 and box["frequency_span_hz"] == 40
    assert 0 < box["time_centroid_seconds"] < t[-1]


def test_representations_have_their_names():
    e = X.Event({"clip_start_seconds": 0.0, "clip_end_seconds": 1.0, "low_frequency": 20.0, "high_frequency": 60.0}, R.normal(size=300), 250)
    cfg = {"sample_rate": 250, "n_fft": 64, "hop_length": 16, "n_mels": 32, "f_min": 0, "f_max": 125}
    for family, n in (("patch", 256), ("handcrafted", 16), ("hybrid", 272)):
        spec = X.representation(family, 16)
        assert len(X.vector(e, cfg, spec)) == len(X.feature_names(spec)) == n
    hog = {"family": "hog", "height": 32, "width": 32}
    v = X.vector(e, cfg, hog)
    assert len(v) == len(X.feature_names(hog)) == 3 * 3 * 4 * 9 and np.isfinite(v).all()
    with pytest.raises(ValueError):
        X.representation("none such")


def test_gradients_of_an_edge():
    image = np.zeros((16, 16))
    image[:, 8:] = 1.0
    h = K.oriented_gradients(image, 9, 8, 2).reshape(4, 9)
    assert (h[:, 1:] == 0).all() and (h[:, 0] > 0).all()  # one vertical edge: a horizontal gradient in every cell

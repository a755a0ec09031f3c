"""Signal kernels on numpy arrays, from their published definitions. Pure functions of one signal; no state."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from callgrid.runtime import by_value

by_value(__name__)

TINY = 1e-12


def bands_of(rate: float, n_fft: int) -> np.ndarray:
    return np.arange(n_fft // 2 + 1) * rate / n_fft


def hann(n: int) -> np.ndarray:
    """Periodic window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def gaussian(n: int, deviation: float) -> np.ndarray:
    """Symmetric window."""
    return np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / deviation) ** 2)


def view(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Whole frames of the signal, one a row; a shorter signal is one frame with zeros behind it."""
    if len(x) < size:
        return np.pad(x, (0, size - len(x)))[None]
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def spectrum(x: np.ndarray, window: np.ndarray, hop: int, n_fft: int | None = None, tail: bool = False) -> np.ndarray:
    """Complex frames x bins transposed to bins x frames; ``tail`` adds zeros so that the last samples have a frame too."""
    size = len(window)
    if tail and len(x) > size and (len(x) - size) % hop:
        x = np.pad(x, (0, hop - (len(x) - size) % hop))
    return np.fft.rfft(view(x, size, hop) * window, n_fft or size, axis=1).T


def centred_power(x: np.ndarray, n_fft: int, win: int, hop: int) -> np.ndarray:
    """Power spectrogram with frames centred on multiples of hop: mirrored ends, the window centred in the transform."""
    n_fft = max(n_fft, win)
    left = (n_fft - win) // 2
    window = np.pad(hann(win), (left, n_fft - win - left))
    half = n_fft // 2
    if len(x) < 2:
        x = np.pad(x, (half, half))
    else:
        x = np.pad(x, (half, half), mode="reflect")
    return np.abs(spectrum(x, window, hop, n_fft)) ** 2


def decibels(power: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    return 10 * np.log10(np.maximum(power, floor))


def mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def hertz(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


@lru_cache(maxsize=64)
def mel_bank(n_mels: int, n_fft: int, rate: float, f_min: float, f_max: float) -> np.ndarray:
    """Triangles over equal steps of the mel scale, peak 1."""
    edges, f = hertz(np.linspace(mel(f_min), mel(f_max), n_mels + 2)), bands_of(rate, n_fft)
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall))


def mel_centres(n_mels: int, f_min: float, f_max: float) -> np.ndarray:
    """Frequency of each mel bin: the mean of its three points on the mel scale."""
    points = np.linspace(mel(f_min), mel(f_max), n_mels + 2)
    return hertz((points[:-2] + points[1:-1] + points[2:]) / 3)


def cosine_transform(x: np.ndarray) -> np.ndarray:
    """Orthonormal DCT-II over the first axis."""
    n = len(x)
    k = np.arange(n)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n)[None] + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis @ x


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    if n == 0:
        return np.zeros(1)
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * keep))


def peak_count(x: np.ndarray) -> int:
    """Local maxima at or above mean plus deviation; a plateau counts once, the ends don't."""
    if len(x) < 3:
        return 0
    level = x.mean() + x.std()
    runs = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    v = x[runs]
    return int(((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= level)).sum())


def ratio(rate: int, wanted: int) -> tuple[int, int, int]:
    """Up, down and the kernel's half length of a resampling, the latter in steps of the raised rate."""
    g = np.gcd(rate, wanted)
    up, down = int(wanted // g), int(rate // g)
    return up, down, 10 * max(up, down)


def resample(x: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Band-limited resampling with a windowed-sinc kernel (Kaiser), rational ratio."""
    if rate == wanted or len(x) == 0:
        return x
    up, down, half = ratio(rate, wanted)
    n = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    kernel = cut * np.sinc(cut * n) * np.kaiser(2 * half + 1, 5.0)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, kernel * up)[half : half + len(wide)]
    return full[::down][: -(-len(x) * up // down)]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres at halves, edges clamped."""
    def axis(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    y0, y1, wy = axis(image.shape[0], height)
    x0, x1, wx = axis(image.shape[1], width)
    rows = image[y0] * (1 - wy)[:, None] + image[y1] * wy[:, None]
    return rows[:, x0] * (1 - wx) + rows[:, x1] * wx


def oriented_gradients(image: np.ndarray, orientations: int = 9, cell: int = 8, block: int = 2) -> np.ndarray:
    """Histogram of oriented gradients: unsigned directions per cell, blocks normalised by L2, clipped at 0.2 and again."""
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    gy[1:-1], gx[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
    m, direction = np.hypot(gx, gy), np.rad2deg(np.arctan2(gy, gx)) % 180
    rows, columns = image.shape[0] // cell, image.shape[1] // cell
    bins = np.minimum((direction * orientations / 180).astype(int), orientations - 1)
    cells = np.zeros((rows, columns, orientations))
    for b in range(orientations):
        part = np.where(bins == b, m, 0.0)[: rows * cell, : columns * cell]
        cells[:, :, b] = part.reshape(rows, cell, columns, cell).mean((1, 3))
    out = []
    for i in range(rows - block + 1):
        for j in range(columns - block + 1):
            v = cells[i : i + block, j : j + block].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(out) if out else np.zeros(0)


def stats(x: np.ndarray) -> list[float]:
    """Mean, deviation, minimum, maximum; zeros when empty."""
    return [float(f(x)) for f in (np.mean, np.std, np.min, np.max)] if np.size(x) else [0.0] * 4


def percentiles(x: np.ndarray, at=(10, 50, 90)) -> list[float]:
    return [float(v) for v in np.percentile(x, at)] if np.size(x) else [0.0] * len(at)


def slope(y: np.ndarray) -> float:
    """Least-squares slope against 0..1."""
    if len(y) < 2:
        return 0.0
    t = np.linspace(0, 1, len(y)) - 0.5
    return float((t * (y - y.mean())).sum() / (t * t).sum())


def spread(f: np.ndarray, p: np.ndarray, tiny: float) -> tuple[float, float, float]:
    """Centroid, bandwidth, normalised entropy of a non-negative profile."""
    q = p / max(p.sum(), tiny)
    c = float((f * q).sum())
    return c, float(np.sqrt(((f - c) ** 2 * q).sum())), float(-(q * np.log2(q + tiny)).sum() / np.log2(max(2, len(q))))


def time_shape(energy: np.ndarray) -> list[float]:
    """Of a unit-sum course: slope, place of the maximum, its share, share of the top tenth, peaks after smoothing."""
    n, at = len(energy), int(energy.argmax())
    total = max(energy.sum(), 1e-20)
    top = np.sort(energy)[-max(1, int(np.ceil(0.1 * n))) :].sum()
    smooth = np.convolve(energy, np.full(3, 1 / 3), "same") if n >= 3 else energy
    return [slope(energy), at / max(1, n - 1), float(energy[at] / total), float(top / total), float(peak_count(smooth))]

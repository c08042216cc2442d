"""Array kernels in numpy: transforms of frames, band layout and masking. No Spark here."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: For qualities 0 to 10 the offset of thresholds in dB and the bandwidth in Hz.
OFFSET_DB = (12.0, 12.0, 9.0, 7.0, 5.0, 3.0, 1.5, 0.0, -2.0, -4.0, -6.0)
BANDWIDTH_HZ = (11000, 11000, 12000, 13000, 14000, 15000, 16000, 19000, 19500, 20000, 20500)


@lru_cache(maxsize=8)
def kaiser_window(n: int, alpha: float = 4.0) -> np.ndarray:
    """A Kaiser-Bessel-derived window of n samples: power-complementary halves."""
    ramp = np.cumsum(np.kaiser(n // 2 + 1, np.pi * alpha))
    half = np.sqrt(ramp[:-1] / ramp[-1])
    return np.concatenate([half, half[::-1]])


def start_window(n: int, short: int) -> np.ndarray:
    """A long rise, flat, a short fall in the middle of the second half, then zeros."""
    out = kaiser_window(n).copy()
    half, gap = n // 2, (n // 2 - short // 2) // 2
    out[half:] = 0
    out[half : half + gap] = 1
    out[half + gap : half + gap + short // 2] = kaiser_window(short)[short // 2 :]
    return out


def stop_window(n: int, short: int) -> np.ndarray:
    return start_window(n, short)[::-1]


@lru_cache(maxsize=8)
def _cosines(n: int) -> np.ndarray:
    """Rows k of cos(pi/m (t + 1/2 + m/2)(k + 1/2)) with m = n/2."""
    m = n // 2
    return np.cos(np.pi / m * (np.arange(n)[None] + 0.5 + m / 2) * (np.arange(m)[:, None] + 0.5))


def mdct(frames: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (…, n/2) of frames (…, n): lapped cosine transform with the window, scaled so that two halves overlap to the signal."""
    n = frames.shape[-1]
    w = kaiser_window(n) if window is None else window
    return (frames * w) @ _cosines(n).T * np.sqrt(4 / n)


def inverse_mdct(coefficients: np.ndarray, window: np.ndarray | None = None) -> np.ndarray:
    n = 2 * coefficients.shape[-1]
    w = kaiser_window(n) if window is None else window
    return coefficients @ _cosines(n) * w * np.sqrt(4 / n)


def spectrum(frames: np.ndarray) -> np.ndarray:
    """n/2 amplitudes of each frame under a four-term Blackman-Harris window."""
    n = frames.shape[-1]
    t = 2 * np.pi * np.arange(n) / n
    w = 0.35875 - 0.48829 * np.cos(t) + 0.14128 * np.cos(2 * t) - 0.01168 * np.cos(3 * t)
    return np.abs(np.fft.rfft(frames * w, axis=-1))[..., : n // 2] / np.sqrt((w * w).sum() / 2)


def bark(hz: np.ndarray | float) -> np.ndarray:
    hz = np.asarray(hz, float)
    return 13 * np.arctan(0.00076 * hz) + 3.5 * np.arctan((hz / 7500) ** 2)


def quiet_db(hz: np.ndarray | float) -> np.ndarray:
    """Terhardt's threshold of hearing."""
    k = np.maximum(np.asarray(hz, float), 20) / 1000
    return 3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4


def spread_db(apart: np.ndarray) -> np.ndarray:
    """Schroeder's spreading of masking over a distance in bark."""
    x = np.asarray(apart, float) + 0.474
    return 15.81 + 7.5 * x - 17.5 * np.sqrt(1 + x * x)


@lru_cache(maxsize=8)
def bands(rate: int, coefficients: int) -> tuple[np.ndarray, np.ndarray]:
    """First coefficients of bands (and the end), and their centres in Hz: half a bark each, four coefficients at least, 64 at most."""
    step = rate / 2 / coefficients
    edges = [0]
    while edges[-1] < coefficients and len(edges) <= 64:
        k = edges[-1]
        goal = bark((k + 0.5) * step) + 0.5
        end = k + 4
        while end < coefficients and bark((end + 0.5) * step) < goal:
            end += 1
        edges.append(min(end, coefficients))
    edges[-1] = coefficients
    first = np.array(edges)
    return first, (first[:-1] + first[1:]) / 2 * step


def band_energy(coefficients: np.ndarray, rate: int) -> np.ndarray:
    first, _ = bands(rate, coefficients.shape[-1])
    return np.add.reduceat(coefficients**2, first[:-1], axis=-1)


def flatness(coefficients: np.ndarray, rate: int) -> np.ndarray:
    """Geometric over arithmetic mean of each band's power."""
    first, _ = bands(rate, coefficients.shape[-1])
    size = np.diff(first)
    p = coefficients**2
    return np.exp(np.add.reduceat(np.log(p + 1e-30), first[:-1], axis=-1) / size) / np.maximum(np.add.reduceat(p, first[:-1], axis=-1) / size, 1e-30)


@lru_cache(maxsize=8)
def spreading(rate: int, coefficients: int) -> np.ndarray:
    """Band to band shares of masking, each row summing to one."""
    z = bark(bands(rate, coefficients)[1])
    m = 10 ** (spread_db(z[:, None] - z[None]) / 10)
    return m / m.sum(axis=1, keepdims=True)


def thresholds(coefficients: np.ndarray, rate: int, quality: int = 7) -> np.ndarray:
    """Allowed noise of each band a coefficient, as power: spread energy below the masker by tonality; NaN above the quality's bandwidth."""
    first, hz = bands(rate, coefficients.shape[-1])
    size = np.diff(first)
    e = band_energy(coefficients, rate)
    mean = np.maximum(e / size, 1e-30)
    live = hz <= BANDWIDTH_HZ[quality]
    flat_db = 10 * np.log10(np.exp(np.log(mean[..., live]).mean(axis=-1)) / mean[..., live].mean(axis=-1))
    tonal = np.clip(flat_db / -60, 0, 1)[..., None]
    below = tonal * (14.5 + bark(hz)) + (1 - tonal) * 5.5
    out = (e @ spreading(rate, coefficients.shape[-1]).T) / size * 10 ** (-below / 10) * 10 ** (OFFSET_DB[quality] / 10)
    out = np.maximum(out, 10 ** (quiet_db(hz) / 10) * 1e-9)
    return np.where(live, out, np.nan)


def limit_cliffs(thr: np.ndarray, most_db: float = 14.0, passes: int = 3) -> np.ndarray:
    """No band allows more than ``most_db`` over its neighbour."""
    out, f = thr.copy(), 10 ** (most_db / 10)
    for _ in range(passes):
        for b in range(1, out.shape[-1]):
            out[..., b] = np.fmin(out[..., b], out[..., b - 1] * f)
        for b in range(out.shape[-1] - 2, -1, -1):
            out[..., b] = np.fmin(out[..., b], out[..., b + 1] * f)
    return np.where(np.isnan(thr), np.nan, out)


def chroma(coefficients: np.ndarray, rate: int) -> np.ndarray:
    """Energy of the 12 pitch classes between 55 and 4000 Hz, in dB below the loudest."""
    hz = (np.arange(coefficients.shape[-1]) + 0.5) * rate / 2 / coefficients.shape[-1]
    held = (hz >= 55) & (hz <= 4000)
    pitch = np.round(12 * np.log2(np.maximum(hz, 1) / 440)).astype(int) % 12
    out = np.stack([(coefficients**2)[..., held & (pitch == k)].sum(axis=-1) for k in range(12)], axis=-1)
    return 10 * np.log10(np.maximum(out, 1e-12) / np.maximum(out.max(axis=-1, keepdims=True), 1e-12))


def reflection_lattice(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(predictor, reflections, residual share) of a row by the Levinson recursion on its autocorrelation."""
    r = np.array([float(x[: len(x) - k] @ x[k:]) for k in range(order + 1)])
    a, refl, err = np.zeros(order), np.zeros(order), r[0]
    if err <= 0:
        return a, refl, 1.0
    for k in range(order):
        c = (r[k + 1] - a[:k] @ r[k:0:-1]) / err
        refl[k] = c
        a[:k] = a[:k] - c * a[:k][::-1]
        a[k] = c
        err *= 1 - c * c
        if err <= 0:
            break
    return a, refl, err / r[0]


def quantise(c: np.ndarray, step: np.ndarray | float, dead: float = 0.62) -> np.ndarray:
    """Rounded multiples of the step; those under ``dead`` are zero."""
    v = c / step
    return np.where(np.abs(v) < dead, 0, np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


def scale_for(allowed: np.ndarray) -> np.ndarray:
    """Scale factor indexes (0 to 127) whose uniform noise is within the allowed power."""
    return np.clip(np.floor(4 * np.log2(np.sqrt(12 * np.maximum(allowed, 1e-30)))) + 48, 0, 127).astype(np.int64)


def step_of(index: np.ndarray | int) -> np.ndarray:
    return 2.0 ** ((np.asarray(index) - 48) / 4)

"""Tools of lossy frames in numpy: noise shaping in time, intensity stereo, substitution, replication and rate search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .kernels import reflection_lattice

ORDER, LEVELS = 8, 16


def reflection_index(k: np.ndarray) -> np.ndarray:
    """Four-bit indexes of reflection coefficients on an arcsine grid."""
    return np.clip(np.round(np.arcsin(np.clip(k, -1, 1)) / (np.pi / 2) * (LEVELS / 2 - 0.5) - 0.5), -LEVELS // 2, LEVELS // 2 - 1).astype(np.int64)


def reflection_value(i: np.ndarray) -> np.ndarray:
    return np.sin((i + 0.5) / (LEVELS / 2 - 0.5) * np.pi / 2) * 0.999


def step_up(k: np.ndarray) -> np.ndarray:
    """Predictor weights of reflection coefficients."""
    a = np.zeros(len(k))
    for i, c in enumerate(k):
        a[:i] = a[:i] - c * a[:i][::-1]
        a[i] = c
    return a


def shape_in_time(c: np.ndarray, least_gain: float = 1.4) -> tuple[np.ndarray, np.ndarray] | None:
    """(filtered coefficients, reflection indexes) if predicting along frequency pays by ``least_gain``, else None."""
    _, k, left = reflection_lattice(c, ORDER)
    if left <= 0 or 1 / left < least_gain:
        return None
    index = reflection_index(k)
    a = step_up(reflection_value(index))
    padded = np.concatenate([np.zeros(ORDER), c])
    return c - sum(w * padded[ORDER - j : len(padded) - j] for j, w in enumerate(a, 1)), index


def unshape_in_time(f: np.ndarray, index: np.ndarray) -> np.ndarray:
    a, out = step_up(reflection_value(index)), np.zeros(len(f) + ORDER)
    for i, v in enumerate(f):
        out[i + ORDER] = v + a @ out[i : i + ORDER][::-1]
    return out[ORDER:]


def intensity(left: np.ndarray, right: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, int] | None:
    """(mid, position in 1.5 dB steps of left over right) of coherent bands, else None."""
    el, er, cross = left @ left, right @ right, left @ right
    if el <= 0 or er <= 0 or abs(cross) / np.sqrt(el * er) < least:
        return None
    position = int(np.clip(np.floor(10 * np.log10(el / er) / 1.5 + 0.5), -16, 16))
    mid = left + right
    energy = mid @ mid
    return mid * np.sqrt((el + er) / 2 / energy) if energy > 0 else mid, position


def from_intensity(mid: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray]:
    r = 10 ** (position * 0.15)
    return mid * np.sqrt(2 * r / (1 + r)), mid * np.sqrt(2 / (1 + r))


def noise_band(frame: int, channel: int, band: int, size: int, energy: float) -> np.ndarray:
    """Noise of the given energy: uniform values of a counter-based generator whose key is the frame and whose stream is the channel and band."""
    own = np.random.Generator(np.random.Philox(key=frame, counter=[0, 0, channel, band]))
    values = own.uniform(-1, 1, size)
    return values * np.sqrt(energy / max(values @ values, np.finfo(float).tiny))


def replicate(c: np.ndarray, first: int, energies: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Coefficients from ``first`` on filled from the octave below, each band at its energy."""
    out = c.copy()
    for k in range(first, len(c)):
        source = k
        while source >= first:
            source //= 2
        out[k] = c[source]
    for a, b, e in zip(edges[:-1], edges[1:], energies, strict=True):
        if a >= first:
            power = out[a:b] @ out[a:b]
            out[a:b] *= np.sqrt(e / power) if power > 0 else 0
    return out


def rate_search(size_of: Callable[[float], float], goal: float, low: float = 1e-3, high: float = 1e6, tries: int = 20, within: float = 0.005) -> float:
    """The scale at which ``size_of`` (falling) is ``goal``: secants of log size over log scale, kept inside a bracket that halves when they stall."""
    a, b = np.log(low), np.log(high)
    fa, fb = np.log(size_of(low) / goal), np.log(size_of(high) / goal)
    if fa <= 0 or fb >= 0:
        return low if fa <= 0 else high
    best = (abs(fa), a) if abs(fa) < abs(fb) else (abs(fb), b)
    for k in range(tries):
        x = (a + b) / 2 if k % 3 == 2 else a + (b - a) * fa / (fa - fb)
        f = np.log(size_of(float(np.exp(x))) / goal)
        best = min(best, (abs(f), x))
        if abs(f) <= within:
            break
        a, b, fa, fb = (x, b, f, fb) if f > 0 else (a, x, fa, f)
    return float(np.exp(best[1]))

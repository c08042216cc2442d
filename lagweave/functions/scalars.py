"""Scalar functions as Columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: float) -> Column:
    return F.lit(float(x))


def step_of(index: Column) -> Column:
    """2 ** ((index - 48) / 4)."""
    return F.pow(_d(2), (index - 48) / 4)


def scale_for(allowed: Column) -> Column:
    """The scale factor index whose uniform noise is within the allowed power, 0 to 127."""
    return F.greatest(F.least(F.floor(4 * F.log2(F.sqrt(12 * allowed))) + 48, F.lit(127)), F.lit(0)).cast("long")


def gain_index(gain: Column) -> Column:
    """Half decibels, -72 to 24; -128 under -36.25 dB."""
    db = 20 * F.log10(F.greatest(F.abs(gain), _d(1e-9)))
    return F.when(db < -36.25, -128).otherwise(F.greatest(F.least(F.floor(2 * db + 0.5), F.lit(24)), F.lit(-72))).cast("long")


def gain_value(index: Column) -> Column:
    return F.when(index == -128, _d(0)).otherwise(F.pow(_d(10), index / 40))


def level_index(energy: Column) -> Column:
    return F.greatest(F.least(F.floor(2 * F.log2(F.greatest(energy, _d(1e-9)))), F.lit(63)), F.lit(0)).cast("long")


def fill_ratio(index: Column) -> Column:
    return F.pow(_d(2), -index / 2)


def stereo_gains(position: Column) -> tuple[Column, Column]:
    """Left and right gains of an intensity position: their squares sum to 2."""
    r = F.pow(_d(10), position * 0.15)
    return F.sqrt(2 * r / (1 + r)), F.sqrt(2 / (1 + r))


def zigzag(r: Column) -> Column:
    return F.when(r > 0, 2 * r - 1).otherwise(-2 * r)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 1, F.floor((u + 1) / 2)).otherwise(-F.floor(u / 2)).cast("long")


def bit_length(u: Column) -> Column:
    """Binary digits of a non-negative number; 0 has none."""
    return F.when(u == 0, 0).otherwise(F.length(F.bin(u))).cast("int")


def golomb_length(v: Column) -> Column:
    """Bits of an Exp-Golomb code."""
    return (2 * (bit_length(v + 1) - 1) + 1).cast("long")


def wrap32(x: Column) -> Column:
    """The low 32 bits as a signed number."""
    low = x.bitwiseAND(0xFFFFFFFF)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def fit_q12(xy: Column, yy: Column) -> Column:
    """The least-squares gain in units of 1/4096, within ±32768."""
    return F.when(yy > 0, F.greatest(F.least(F.floor(xy.cast("double") / yy * 4096 + 0.5), F.lit(32768)), F.lit(-32768))).otherwise(0).cast("long")


def apply_q12(gain: Column, x: Column) -> Column:
    """gain * x / 4096, rounded half away from zero on the positive side."""
    p = gain * x
    return F.when(p >= 0, F.shiftright(p + 2048, 12)).otherwise(F.shiftright(p - 2047, 12))


def half_octave(mean: Column) -> Column:
    """0 to 39: the class of a running magnitude."""
    return F.when(mean <= 0, 0).otherwise(F.least(F.greatest(F.floor(2 * F.log2(mean.cast("double"))) + 1, F.lit(0)), F.lit(39))).cast("long")


def erb_rate(hz: Column) -> Column:
    return 21.4 * F.log10(0.00437 * hz + 1)


def loudness(e: Column, r: Column) -> Column:
    return F.greatest(F.pow(0.5 + 0.5 * e / r, _d(0.23)) - 1, _d(0))


def bark(hz: Column) -> Column:
    return 13 * F.atan(0.00076 * hz) + 3.5 * F.atan(F.pow(hz / 7500, _d(2)))


def quiet_db(hz: Column) -> Column:
    k = F.greatest(hz, _d(20)) / 1000
    return 3.64 * F.pow(k, _d(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, _d(2))) + 1e-3 * F.pow(k, _d(4))


def spread_db(apart: Column) -> Column:
    x = apart + 0.474
    return 15.81 + 7.5 * x - 17.5 * F.sqrt(1 + x * x)


def binary_entropy(n: Column, ones: Column) -> Column:
    """Bits of n choices of which some are ones."""
    p = ones / n
    return F.when((ones == 0) | (ones == n), _d(0)).otherwise(-n * (p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def cbr_bytes(kbit: Column, samples: Column, rate: int) -> Column:
    return F.floor(kbit * 125 * samples / rate).cast("long")


def duration(samples: Column, rate: int) -> Column:
    """MM:SS.mmm."""
    ms = F.floor(samples * 1000 / rate + 0.5).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000).cast("long"), F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def frames_per_entry(seconds: Column, rate: int, hop: int = 1024) -> Column:
    return F.greatest(F.floor(seconds * rate / hop), F.lit(1)).cast("long")


def tukey(i: Column, n: int, share: float = 0.5) -> Column:
    """A cosine taper over ``share`` of the window."""
    edge = share * (n - 1) / 2
    return F.when(i < edge, 0.5 * (1 + F.cos(F.pi() * (i / edge - 1)))).when(i > n - 1 - edge, 0.5 * (1 + F.cos(F.pi() * (i / edge - 2 / share + 1)))).otherwise(_d(1))


def mime(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".png"), "image/png").when(n.endswith(".jpg") | n.endswith(".jpeg"), "image/jpeg").when(n.endswith(".webp"), "image/webp").otherwise("application/octet-stream")

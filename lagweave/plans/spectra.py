"""Queries of the array kernels: frames as arrays, transformed in Arrow batches. No SQL makes these; tests hold them against direct definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import framing
from ..operators.signals import mono
from .registry import query

HOP, RATE = 128, 44_100


def mapped(framed: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``kernel`` over the frames (f, w) of each Arrow batch as one matrix; its columns beside f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = b.column("w").flatten().to_numpy().astype(float).reshape(b.num_rows, -1)
                made = {k: pa.array(v) if v.ndim == 1 else pa.array(list(v)) for k, v in kernel(w).items()}
                yield pa.RecordBatch.from_arrays([b.column("f"), *made.values()], names=["f", *made])

    return framed.select("f", "w").mapInArrow(run, f"f long, {schema}")


def frames(spark, d) -> DataFrame:
    return framing.windowed(mono(spark, d), HOP)


@query()
def trf_06_spectrum(spark, d):
    return mapped(frames(spark, d), lambda w: {"amplitude": kernels.spectrum(w)}, "amplitude array<double>")


@query()
def trf_08_mdct(spark, d):
    return mapped(frames(spark, d), lambda w: {"c": kernels.mdct(w)}, "c array<double>")


@query()
def psy_06_bands(spark, d):
    return mapped(frames(spark, d), lambda w: {"energy": kernels.band_energy(c := kernels.mdct(w), RATE), "flat": kernels.flatness(c, RATE)}, "energy array<double>, flat array<double>")


@query()
def psy_19_features(spark, d):
    """Everything a frame is described by, in one pass: thresholds, energies, chroma."""

    def kernel(w: np.ndarray) -> dict[str, np.ndarray]:
        c = kernels.mdct(w / 32768)
        return {"thr": kernels.limit_cliffs(kernels.thresholds(c, RATE)), "energy": kernels.band_energy(c, RATE), "chroma": kernels.chroma(c, RATE)}

    return mapped(frames(spark, d), kernel, "thr array<double>, energy array<double>, chroma array<double>")


@query()
def ls_02_quantised(spark, d):
    """Coefficients quantised by the steps that their bands' thresholds allow, and put back."""

    def kernel(w: np.ndarray) -> dict[str, np.ndarray]:
        c = kernels.mdct(w)
        first, _ = kernels.bands(RATE, c.shape[1])
        thr = np.nan_to_num(kernels.thresholds(c, RATE), nan=1e30)
        step = np.repeat(kernels.step_of(kernels.scale_for(thr)), np.diff(first), axis=1)
        q = kernels.quantise(c, step)
        return {"q": q, "y": q * step}

    return mapped(frames(spark, d), kernel, "q array<bigint>, y array<double>")


@query("SELECT n, x FROM sig")
def ls_06_perfect_reconstruction(spark, d):
    """MDCT, inverse and overlap-add: the signal comes back, rounded."""
    back = mapped(frames(spark, d), lambda w: {"y": kernels.inverse_mdct(kernels.mdct(w))}, "y array<double>")
    rows = back.select("f", F.posexplode("y").alias("i", "x"))
    out = framing.overlap_add(rows, HOP).select("n", F.floor(F.col("y") + 0.5).cast("long").alias("x"))
    return out.join(mono(spark, d).select("n"), "n", "left_semi").select("n", "x")

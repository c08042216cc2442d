"""Queries of adaptive predictors and lossy tools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import adaptive, kernels, lossy
from ..operators.signals import by_user, div, mono, stereo
from .registry import query
from .spectra import frames, mapped


@query("SELECT user_id, n, x FROM sigu", "sigu")
def ll_13_cascade(spark, d):
    """Each user's signal through least squares, LMS stages and their mix, and back: it must return."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy())
        x = table["x"].to_numpy()[order]
        return pa.table({"user_id": table["user_id"], "n": table["n"].take(pa.array(order)), "x": pa.array(adaptive.restore(adaptive.residual(x)))})

    return by_user(spark, d).groupBy("user_id").applyInArrow(run, "user_id long, n long, x long")


@query()
def ls_07_shaping(spark, d):
    """f, gain: how much of each frame's coefficients prediction along frequency takes away, where it pays."""

    def kernel(w: np.ndarray) -> dict[str, np.ndarray]:
        c = kernels.mdct(w)
        gain = [1.0 if (s := lossy.shape_in_time(x)) is None else float((x @ x) / max(s[0] @ s[0], 1e-12)) for x in c]
        return {"gain": np.array(gain)}

    return mapped(frames(spark, d), kernel, "gain double")


@query("""WITH b AS (SELECT n // 64 AS f, n % 4 AS b, CAST(sum(l * l) AS DOUBLE) AS el, CAST(sum(r * r) AS DOUBLE) AS er, CAST(sum(l * r) AS DOUBLE) AS x FROM sig2 GROUP BY ALL)
SELECT f, b, CAST(greatest(least(floor(10 * log10(el / er) / 1.5 + 0.5), 16), -16) AS BIGINT) AS position FROM b WHERE el > 0 AND er > 0 AND abs(x) / sqrt(el * er) >= 0.75""", "sig2")
def ls_12_intensity(spark, d):
    """Bands whose channels are coherent, with the position that replaces one of them."""
    e = lambda p, q: F.sum(F.col(p) * F.col(q)).cast("double")
    b = stereo(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 4).alias("b")).agg(e("l", "l").alias("el"), e("r", "r").alias("er"), e("l", "r").alias("x"))
    b = b.filter("el > 0 AND er > 0 AND abs(x) / sqrt(el * er) >= 0.75")
    return b.select("f", "b", F.greatest(F.least(F.floor(10 * F.log10(F.col("el") / F.col("er")) / 1.5 + 0.5), F.lit(16)), F.lit(-16)).cast("long").alias("position"))


@query("""WITH s AS (SELECT unnest(range(9)) AS k), b AS (SELECT k, sum(1 + log2(1 + abs((x + (CAST(1 AS BIGINT) << k) // 2) >> k))) AS bits FROM sig, s GROUP BY k), g AS (SELECT bits * 0.7 AS goal FROM b WHERE k = 0)
SELECT CAST(min(k) AS BIGINT) AS drop_bits FROM b, g WHERE bits <= goal""")
def ec_14_rate(spark, d):
    """The fewest bits to drop for 70 % of the size: every choice is estimated in one pass over the signal."""
    sizes = [F.sum(1 + F.log2(1 + F.abs(F.shiftright(F.col("x") + (1 << k) // 2, k)))).alias(f"b{k}") for k in range(9)]
    fits = F.array(*(F.when(F.col(f"b{k}") <= 0.7 * F.col("b0"), F.lit(k).cast("long")) for k in range(9)))
    return mono(spark, d).agg(*sizes).select(F.array_min(fits).alias("drop_bits"))


@query()
def ls_09_noise(spark, d):
    """f, noise: a band of seeded noise at each frame's energy."""

    # The seed is the frame's own number, so it can't come from a row's place in a batch.
    def by_frame(batches):
        for b in batches:
            if b.num_rows:
                w = b.column("w").flatten().to_numpy().astype(float).reshape(b.num_rows, -1)
                made = [lossy.noise_band(f, 0, 0, 16, float(x @ x)) for f, x in zip(b.column("f").to_pylist(), w, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("f"), pa.array(made)], names=["f", "noise"])

    return frames(spark, d).mapInArrow(by_frame, "f long, noise array<double>")

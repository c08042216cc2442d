"""The timeline cut into overlapping frames, and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import div, halo, near, owned


def frame_count(samples: Column, hop: int) -> Column:
    """Frames of a signal: the hops that cover it and one more."""
    return (F.ceil(samples / hop) + 1).cast("long")


def frames(signal: DataFrame, hop: int, halves: int = 2, first: int | None = None) -> DataFrame:
    """f, i and the signal's columns: each sample in the ``halves`` frames that cover it.

    Frame f is ``halves`` hops long and begins at f*hop - ``first`` (one hop, if not given); i counts
    from its beginning. Frames reach past both ends; samples there are zero, so they have no rows.
    """
    first = hop if first is None else first
    last = F.floor((F.col("n") + first) / hop).cast("long")
    out = signal.withColumn("f", F.explode(F.sequence(last - (halves - 1), last))).filter("f >= 0")
    return out.withColumn("i", F.col("n") - (F.col("f") * hop - first))


def frame_energy(signal: DataFrame, size: int) -> DataFrame:
    """f, cnt, sx, energy, peak of tumbling blocks."""
    return signal.groupBy(div("n", size).alias("f")).agg(F.count("*").alias("cnt"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.max(F.abs("x")).alias("peak"))


def windowed(signal: DataFrame, hop: int) -> DataFrame:
    """f, w: frames as arrays of 2*hop samples, zeros where the signal has none."""
    rows = frames(signal, hop).groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    return rows.select("f", F.transform(F.sequence(F.lit(0), F.lit(2 * hop - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("w"))


def overlap_add(framed: DataFrame, hop: int) -> DataFrame:
    """n, y, c: frames (f, i, x) summed where they overlap, and how many did."""
    return framed.groupBy((F.col("f") * hop - hop + F.col("i")).alias("n")).agg(F.sum("x").alias("y"), F.count("*").alias("c"))


def decimate(signal: DataFrame, by: int = 8) -> DataFrame:
    """k, s: sums of ``by`` neighbouring samples."""
    return signal.groupBy(div("n", by).alias("k")).agg(F.sum("x").alias("s"))


def envelope(signal: DataFrame, size: int = 32) -> DataFrame:
    """b, level: 10 log10 of the mean square of each block, from a floor of 1e-10."""
    return signal.groupBy(div("n", size).alias("b")).agg(F.round(10 * F.log10(F.avg(F.col("x").cast("double") * F.col("x")) + 1e-10), 6).alias("level"))


def moving_sum(signal: DataFrame, reach: int) -> DataFrame:
    """n, s: sums over ``reach`` samples to either side."""
    w = near().rangeBetween(-reach, reach)
    return owned(halo(signal, reach, reach).withColumn("s", F.sum("x").over(w)), "n", "s")


def differences(signal: DataFrame) -> DataFrame:
    """n, r0 to r3: what fixed polynomial predictors of orders 0 to 3 leave; history before the signal is zero."""
    x = [F.col("x")] + [F.coalesce(F.lag("x", k).over(near()), F.lit(0)) for k in (1, 2, 3)]
    rows = halo(signal, 3, 0)
    rows = rows.withColumns({f"_{k}": c for k, c in enumerate(x)})
    a, b, c, d = (F.col(f"_{k}") for k in range(4))
    return owned(rows, "n", a.alias("r0"), (a - b).alias("r1"), (a - 2 * b + c).alias("r2"), (a - 3 * b + 3 * c - d).alias("r3"))


def neighbour_median(signal: DataFrame, reach: int = 6) -> DataFrame:
    """n, med: the median of up to ``reach`` neighbours to either side, the sample itself excluded (the upper of two)."""
    w = near().rowsBetween(-reach, reach)
    rows = halo(signal, reach, reach)
    seen = F.collect_list(F.struct(F.col("x"), F.col("n"))).over(w)
    rows = rows.withColumn("v", F.sort_array(F.transform(F.filter(seen, lambda s: s["n"] != F.col("n")), lambda s: s["x"])))
    return owned(rows.withColumn("med", F.when(F.size("v") > 0, F.element_at("v", F.floor(F.size("v") / 2).cast("int") + 1))), "n", "med")

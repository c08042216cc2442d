"""Two signals compared: noise, levels, attacks, stereo image and the verdict. Frames come from equi-joins on position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import div, halo, near, owned


def pair(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """n, x, y, e: both signals and the error, where both have a sample."""
    return original.select("n", "x").join(decoded.select("n", F.col("x").alias("y")), "n").withColumn("e", F.col("x") - F.col("y"))


def energy(c: str) -> Column:
    return F.sum(F.col(c) * F.col(c))


def ratio_db(top: Column, bottom: Column) -> Column:
    """10 log10 of a ratio, 200 for no noise, -200 for no signal."""
    return F.when(bottom <= 0, 200.0).when(top <= 0, -200.0).otherwise(10 * F.log10(top.cast("double") / bottom))


def snr(both: DataFrame) -> DataFrame:
    return both.agg(F.round(ratio_db(energy("x"), energy("e")), 6).alias("snr"), F.max(F.abs("e")).alias("maxdiff"))


def attacks(both: DataFrame, size: int = 16, factor: float = 1.5) -> DataFrame:
    """b, pre_snr: blocks of at least ``factor`` times the mean energy of the eight before, with the signal to noise of those eight."""
    blocks = both.groupBy(div("n", size).alias("b")).agg(energy("x").alias("ex"), energy("e").alias("ee"))
    w = near("b").rowsBetween(-8, -1)
    seen = halo(blocks, 8, 0, n="b").withColumns({"c": F.count("*").over(w), "px": F.sum("ex").over(w), "pe": F.sum("ee").over(w)})
    return owned(seen.filter(F.expr(f"c = 8 AND 8 * ex >= {factor} * px")), "b", F.round(ratio_db(F.col("px"), F.col("pe")), 6).alias("pre_snr"))


def ghosts(both: DataFrame, size: int = 16, reach: int = 8) -> DataFrame:
    """b, attack: blocks up to ``reach`` before an attack whose error is louder than the signal. Attacks are dealt to the blocks before them: an equi-join."""
    blocks = both.groupBy(div("n", size).alias("b")).agg(energy("x").alias("ex"), energy("e").alias("ee"))
    dealt = attacks(both, size).select(F.col("b").alias("attack"), F.explode(F.sequence(F.col("b") - reach, F.col("b") - 1)).alias("b"))
    return blocks.join(dealt, "b").filter("ee > ex").select("b", "attack")

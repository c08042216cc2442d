"""Runs of equal keys (gaps and islands), change counts and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import CHUNK, halo, near, owned


def islands(rows: DataFrame, key: Column, n: str = "n", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, key, f0, f1, len: maximal runs of neighbouring positions with an equal key.

    Positions are grouped by their distance from the rank of their key, so only rows of one key share
    a task's order.
    """
    w = Window.partitionBy(*by, "key").orderBy(n)
    marked = rows.withColumn("key", key).withColumn("_run", F.col(n) - F.row_number().over(w))
    return marked.groupBy(*by, "key", "_run").agg(F.min(n).alias("f0"), F.max(n).alias("f1"), F.count("*").alias("len")).drop("_run")


def starts(rows: DataFrame, keys: list[str], n: str = "n", steps: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with start: true where a key differs from the row before, or a column of ``steps`` from its value there and the step."""
    held = halo(rows, 1, 0, n=n)
    same = F.lag(n).over(near(n)).eqNullSafe(F.col(n) - 1)
    for k in keys:
        same = same & F.lag(k).over(near(n)).eqNullSafe(F.col(k))
    for k, step in (steps or {}).items():
        same = same & F.lag(k).over(near(n)).eqNullSafe(F.col(k) - step)
    return owned(held.withColumn("start", ~F.coalesce(same, F.lit(False))), *rows.columns, "start")


def toggles(signal: DataFrame, by: str, state: Column) -> DataFrame:
    """``by``, c: how often the state changes along each signal."""
    w = Window.partitionBy(by).orderBy("n")
    flips = signal.withColumn("_s", state).withColumn("_flip", (F.lag("_s").over(w) != F.col("_s")).cast("long"))
    return flips.groupBy(by).agg(F.coalesce(F.sum("_flip"), F.lit(0)).alias("c"))


def running_sum(signal: DataFrame, value: str = "x", n: str = "n", chunk: int = CHUNK) -> DataFrame:
    """``signal`` with run: the sum of ``value`` up to each position.

    Sums of chunks are run first; a sample adds its place in its own chunk. One task never orders the
    whole signal.
    """
    c = F.floor(F.col(n) / chunk).cast("long")
    rows = signal.withColumn("chunk", c)
    totals = rows.groupBy("chunk").agg(F.sum(value).alias("_total"))
    before = totals.select("chunk", F.coalesce(F.sum("_total").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.sum(value).over(near(n).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, "chunk").select(*signal.columns, (F.col("_base") + F.col("_own")).alias("run"))

"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_staged, staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the component's smallest node) for every node of ``edges`` (columns a, b).

    Alternates large stars and small stars until the edges are a star around each smallest node. A
    round is two aggregations, which combine before their shuffles, and two equi-joins, which AQE
    splits where a node is hot; it ends in a table in the shared folder. Self loops are ignored.
    """
    now = staged(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    seen, rounds = None, 0
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen:
            break
        seen, rounds = mark, rounds + 1
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        before, now = now, staged(small, f"{name}-{rounds}")
        drop_staged(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b")).distinct()

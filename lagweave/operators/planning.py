"""Choosing lineages: a two-or-more-state dynamic program, block boundaries, depths, reachability and segment lookup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import CHUNK, halo, near, owned

SWITCH = 480


def cheapest_path(costs: DataFrame, by: str, switch: int = SWITCH) -> DataFrame:
    """``by``, f, state, total: for each group the path over frames of least cost, a change of state costing ``switch``; ties to the lower state, to staying.

    ``costs`` has f (dense from 0) and cost, an array of one integer a state. A group is a signal (or
    an independent segment of one): the recursion is sequential inside it and groups run apart.
    """

    def solve(table: pa.Table) -> pa.Table:
        order = np.argsort(table["f"].to_numpy())
        c = np.stack(table["cost"].to_numpy(zero_copy_only=False))[order].astype(np.int64)
        path, back = c[0].copy(), np.zeros(c.shape, np.int64)
        states = np.arange(c.shape[1])
        for k in range(1, len(c)):
            best = int(path.argmin())
            stay = path <= path[best] + switch
            back[k] = np.where(stay, states, best)
            path = c[k] + np.where(stay, path, path[best] + switch)
        state, out = int(path.argmin()), np.zeros(len(c), np.int64)
        for k in range(len(c) - 1, -1, -1):
            out[k], state = state, int(back[k, state])
        return pa.table({by: table[by].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(c), np.int64))), "f": table["f"].take(pa.array(order)), "state": pa.array(out), "total": pa.array(np.full(len(c), path.min()))})

    kind = costs.schema[by].dataType.simpleString()
    return costs.select(by, F.col("f").cast("long"), "cost").groupBy(by).applyInArrow(solve, f"`{by}` {kind}, f long, state long, total long")


def lineage_blocks(plan: DataFrame, most: int = 64, hop: int = 1) -> DataFrame:
    """start_frame, frame_count, s0: runs of frames that continue one lineage (s grows with f, or is null throughout), cut every ``most`` frames.

    A run is known by f - s, so only its own rows are ordered together.
    """
    key = F.coalesce(F.col("s") - F.col("f") * hop, F.lit(-(1 << 62)).cast("long"))
    w = Window.partitionBy("_key").orderBy("f")
    rows = plan.withColumn("_key", key).withColumn("_run", F.col("f") - F.row_number().over(w))
    own = Window.partitionBy("_key", "_run")
    cut = F.floor((F.col("f") - F.min("f").over(own)) / most)
    return rows.withColumn("_cut", cut).groupBy("_key", "_run", "_cut").agg(F.min("f").alias("start_frame"), F.count("*").alias("frame_count"), F.min("s").alias("s0")).drop("_key", "_run", "_cut")


def as_of(points: DataFrame, marks: DataFrame, n: str = "n", mark: str = "mark", value: str = "value", chunk: int = CHUNK) -> DataFrame:
    """``points`` with mark and value: the last mark at or before each point.

    Points and marks meet in the order of their chunk; a chunk begins with the last mark before it,
    found from the chunks' last marks.
    """
    c = lambda col: F.floor(F.col(col) / chunk).cast("long")
    m = marks.select(c(mark).alias("chunk"), F.col(mark).alias("_n"), F.struct(F.col(mark).alias("mark"), F.col(value).alias("value")).alias("_m"))
    p = points.withColumn("chunk", c(n)).withColumn("_n", F.col(n))
    last = m.groupBy("chunk").agg(F.max("_m").alias("_m"), F.lit(True).alias("known")).select("chunk", "_m", "known")
    spots = last.unionByName(p.select("chunk").distinct().withColumns({"_m": F.lit(None).cast(last.schema["_m"].dataType), "known": F.lit(False)}))
    carried = spots.withColumn("_carry", F.last("_m", True).over(Window.orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1))).filter("NOT known").select("chunk", "_carry")
    both = p.select("chunk", "_n", F.struct(*points.columns).alias("_p")).withColumn("_m", F.lit(None).cast(m.schema["_m"].dataType)).unionByName(m.withColumn("_p", F.lit(None).cast(p.select(F.struct(*points.columns).alias("s")).schema["s"].dataType)))
    w = Window.partitionBy("chunk").orderBy("_n", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_m", True).over(w)).filter("_p IS NOT NULL").join(carried, "chunk")
    return seen.withColumn("_v", F.coalesce("_last", "_carry")).select("_p.*", F.col("_v.mark").alias("mark"), F.col("_v.value").alias("value"))


def overlap_frames(source: Column, hop: int) -> Column:
    """Frames whose window of two hops overlaps the window from ``source`` on."""
    return F.sequence(F.greatest(F.floor((source + hop) / hop) - 1, F.lit(0)).cast("long"), F.floor((source + 3 * hop - 1) / hop).cast("long"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node: all that can be reached along ``edges`` (a -> b) from ``starts`` (node), themselves included.

    Breadth first, a join a level; levels end in the shared checkpoint folder, and end when nothing
    new is found.
    """
    known = starts.select("node").distinct().checkpoint()
    front = known
    while True:
        step = front.join(edges, front["node"] == edges["a"]).select(edges["b"].alias("node")).distinct().join(known, "node", "left_anti").checkpoint()
        if step.isEmpty():
            return known
        known = known.unionByName(step).checkpoint()
        front = step


def block_types(attacks: DataFrame) -> DataFrame:
    """f, bt from f, short: SHORT where there is an attack, START before it, STOP past it, both: SHORT too; LONG else."""
    rows = halo(attacks, 1, 1, n="f")
    w = near("f")
    after, before = F.coalesce(F.lead("short").over(w), F.lit(False)), F.coalesce(F.lag("short").over(w), F.lit(False))
    bt = F.when(F.col("short") | (after & before), "SHORT").when(after, "START").when(before, "STOP").otherwise("LONG")
    return owned(rows.withColumn("bt", bt), "f", "bt")

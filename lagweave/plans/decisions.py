"""Queries of planning and coding decisions, and of segments that are decoded step by step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import planning
from ..operators.signals import by_user, div, halo, mono, near, owned, table
from ..sources.shared import ready
from .registry import query
from .search import _KNN, candidates
from .timeline import _TRANSIENT, transients


@query(_KNN.format(k=4) + " SELECT t, s, rk, round(d, 6) AS d FROM k WHERE rk <= 2", "fp")
def pl_02_top_k(spark, d):
    return candidates(spark, d, 4).filter("rk <= 2").select("t", "s", "rk", F.round("d", 6).alias("d"))


@query("SELECT n // 64 AS f, round(sum(CASE WHEN x = 0 THEN 0.25 ELSE 2.2 + 1.35 * log2(1 + abs(x)) END) + 0.3, 4) AS bits FROM sig GROUP BY 1")
def pl_07_fast_estimate(spark, d):
    return mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.round(F.sum(F.when(F.col("x") == 0, 0.25).otherwise(2.2 + 1.35 * F.log2(1 + F.abs("x")))) + 0.3, 4).alias("bits"))


@query("""WITH c AS (SELECT n // 64 AS f, x // 2048 AS s, count(*) AS c FROM sig GROUP BY ALL), t AS (SELECT f, sum(c) AS t FROM c GROUP BY f)
SELECT f, round(sum(-c * log2(CAST(c AS DOUBLE) / t)), 4) AS bits FROM c JOIN t USING (f) GROUP BY f""")
def pl_08_entropy_estimate(spark, d):
    """Empirical entropy of a frame's symbols: counts by symbol, then by frame, both combined before their shuffles."""
    c = mono(spark, d).groupBy(div("n", 64).alias("f"), div("x", 2048).alias("s")).agg(F.count("*").alias("c"))
    return c.groupBy("f").agg(F.round(F.sum("c") * F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")), 4).alias("bits"))


@query("SELECT n // 64 AS f, round(sum(CASE WHEN abs(x) > 1 THEN 0.5 * log2(CAST(x AS DOUBLE) * x) ELSE 0 END) + 0.3 * count(*), 4) AS bits FROM sig GROUP BY 1")
def pl_10_lossless_estimate(spark, d):
    return mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.round(F.sum(F.when(F.abs("x") > 1, 0.5 * F.log2(F.col("x").cast("double") * F.col("x"))).otherwise(0.0)) + 0.3 * F.count("*"), 4).alias("bits"))


@query("""WITH RECURSIVE c AS (SELECT user_id, n AS f, x AS a, 10000 + (x * 7 % 3000) AS b FROM sigu),
p AS (SELECT user_id, f, a AS pa, b AS pb FROM c WHERE f = 0 UNION ALL
SELECT c.user_id, c.f, c.a + least(p.pa, p.pb + 480), c.b + least(p.pb, p.pa + 480) FROM p JOIN c ON c.user_id = p.user_id AND c.f = p.f + 1)
SELECT user_id, max(f) + 1 AS frames, arg_max(least(pa, pb), f) AS total FROM p GROUP BY user_id""", "sigu")
def pl_11_cheapest_path(spark, d):
    """Two states over each user's signal: the cost of the cheapest path, from the path that is found."""
    c = by_user(spark, d).select("user_id", F.col("n").alias("f"), F.array(F.col("x"), 10000 + F.col("x") * 7 % 3000).alias("cost"))
    path = planning.cheapest_path(c, "user_id")
    w = Window.partitionBy("user_id").orderBy("f")
    own = path.join(c, ["user_id", "f"]).withColumn("_c", F.element_at("cost", (F.col("state") + 1).cast("int")) + F.when(F.lag("state").over(w) != F.col("state"), 480).otherwise(0))
    return own.groupBy("user_id").agg(F.count("*").alias("frames"), F.sum("_c").alias("total"))


@query("""WITH z AS (SELECT n // 64 AS f, avg(x) AS m FROM sig GROUP BY 1), p AS (SELECT f, CASE WHEN m > 7000 THEN f - f % 5 ELSE NULL END AS s FROM z),
k AS (SELECT f, s, COALESCE(s - f, -1000000) AS key FROM p), r AS (SELECT *, f - row_number() OVER (PARTITION BY key ORDER BY f) AS run FROM k), c AS (SELECT *, (f - min(f) OVER (PARTITION BY key, run)) // 64 AS cut FROM r)
SELECT min(f) AS start_frame, count(*) AS frame_count, min(s) AS s0 FROM c GROUP BY key, run, cut""")
def pl_18_blocks(spark, d):
    z = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.avg("x").alias("m"))
    p = z.select("f", F.when(F.col("m") > 7000, F.col("f") - F.col("f") % 5).alias("s"))
    return planning.lineage_blocks(p)


@query(_KNN.format(k=1) + """, i AS (SELECT t, t - s AS lag, d, t - row_number() OVER (PARTITION BY (t - s) // 50 ORDER BY t) AS g FROM k)
SELECT lag // 50 AS lag, min(t) AS f0, max(t) AS f1, count(*) AS len, round(avg(d), 6) AS d FROM i GROUP BY lag // 50, g HAVING count(*) >= 2""", "fp")
def pl_20_runs(spark, d):
    """Runs of frames whose best source is at a similar lag."""
    k = candidates(spark, d, 1).withColumn("lag", F.floor((F.col("t") - F.col("s")) / 50).cast("long"))
    w = Window.partitionBy("lag").orderBy("t")
    r = k.withColumn("_g", F.col("t") - F.row_number().over(w)).groupBy("lag", "_g").agg(F.min("t").alias("f0"), F.max("t").alias("f1"), F.count("*").alias("len"), F.round(F.avg("d"), 6).alias("d"))
    return r.filter("len >= 2").drop("_g")


@query("SELECT user_id, round(median(x), 3) AS med, round(avg(CASE WHEN x <= 5000 THEN 1.0 ELSE 0 END), 6) AS share FROM sigu GROUP BY 1", "sigu")
def pl_22_medians(spark, d):
    return by_user(spark, d).groupBy("user_id").agg(F.round(F.percentile("x", F.lit(0.5)), 3).alias("med"), F.round(F.avg(F.when(F.col("x") <= 5000, 1.0).otherwise(0.0)), 6).alias("share"))


@query("WITH f AS (SELECT n // 64 AS f, max(abs(x)) AS peak FROM sig GROUP BY 1) SELECT f, peak FROM f ORDER BY peak DESC, f LIMIT 16")
def pl_17_worst(spark, d):
    f = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.max(F.abs("x")).alias("peak"))
    return f.orderBy(F.desc("peak"), "f").limit(16)


@query(_TRANSIENT + """, s AS (SELECT f, part > 0 AND e_max * part > 1.5 * pre AS short FROM t), n AS (SELECT *, COALESCE(lag(short) OVER (ORDER BY f), false) AS b, COALESCE(lead(short) OVER (ORDER BY f), false) AS a FROM s)
SELECT f, CASE WHEN short OR (a AND b) THEN 'SHORT' WHEN a THEN 'START' WHEN b THEN 'STOP' ELSE 'LONG' END AS bt FROM n""")
def ec_03_block_types(spark, d):
    t = transients(spark, d).select("f", ((F.col("part") > 0) & (F.col("e_max") * F.col("part") > 1.5 * F.col("pre"))).alias("short"))
    return planning.block_types(t)


@query("""WITH w AS (SELECT n // 64 AS f, round(10 * log10(sum(x * x) + 1.0), 6) AS e FROM sig GROUP BY 1), p AS (SELECT f, e, lag(e) OVER (ORDER BY f) AS p, lead(e) OVER (ORDER BY f) AS q FROM w)
SELECT f, e FROM p WHERE abs(e - p) <= 0.3 AND abs(e - q) <= 0.3""")
def ls_08_steady_bands(spark, d):
    """Frames within 0.3 dB of both neighbours, as noise substitution asks."""
    e = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.round(10 * F.log10(F.sum(F.col("x") * F.col("x")) + 1.0), 6).alias("e"))
    w = near("f")
    rows = halo(e, 1, 1, n="f").withColumns({"p": F.lag("e").over(w), "q": F.lead("e").over(w)})
    return owned(rows.filter("abs(e - p) <= 0.3 AND abs(e - q) <= 0.3"), "f", "e")


@query("SELECT n, CASE WHEN abs(x / 500.0) < 0.62 THEN 0 ELSE CAST(sign(x) * floor(abs(x / 500.0) + 0.5) AS BIGINT) END AS q, CASE WHEN abs(x / 500.0) < 0.62 THEN 0 ELSE CAST(sign(x) * floor(abs(x / 500.0) + 0.5) AS BIGINT) END * 500 AS y FROM sig")
def ls_01_dead_zone(spark, d):
    v = F.abs(F.col("x") / F.lit(500.0))
    q = F.when(v < 0.62, 0).otherwise((F.signum(F.col("x").cast("double")) * F.floor(v + 0.5)).cast("long"))
    return mono(spark, d).select("n", q.alias("q"), (q * 500).alias("y"))


@query("SELECT n // 256 AS f, n % 4 AS region, round(sqrt(avg(CAST(x AS DOUBLE) * x) FILTER (x < 600)), 4) AS rms FROM sig GROUP BY ALL")
def ls_09_fill_levels(spark, d):
    """The root mean square of what a quantiser would drop, by frame and region."""
    small = F.when(F.col("x") < 600, F.col("x").cast("double") * F.col("x"))
    return mono(spark, d).groupBy(div("n", 256).alias("f"), (F.col("n") % 4).alias("region")).agg(F.round(F.sqrt(F.avg(small)), 4).alias("rms"))


@query("""WITH b AS (SELECT n % 512 AS k, n // 512 AS f, x FROM sig) SELECT b.f, b.k, s.x AS copy FROM b JOIN b s ON s.f = b.f AND s.k = b.k // 2 WHERE b.k >= 256""")
def ls_10_replication(spark, d):
    """The upper half of each block filled from the octave below."""
    b = mono(spark, d).select(div("n", 512).alias("f"), (F.col("n") % 512).alias("k"), "x")
    low = b.select("f", F.explode(F.array(2 * F.col("k"), 2 * F.col("k") + 1)).alias("k"), F.col("x").alias("copy")).filter("k >= 256 AND k < 512")
    return b.filter("k >= 256").join(low, ["f", "k"]).select("f", "k", "copy")


@query("SELECT count(*) FILTER (x > 20000) AS clipped, max(x) AS peak, CAST(96 + 12 * count(DISTINCT n // 64) + sum(abs(x) // 256) AS BIGINT) AS bytes FROM sig")
def ec_20_container_size(spark, d):
    return mono(spark, d).agg(F.count_if(F.col("x") > 20000).alias("clipped"), F.max("x").alias("peak"), (96 + 12 * F.countDistinct(div("n", 64)) + F.sum(F.floor(F.abs("x") / 256))).cast("long").alias("bytes"))


_SEGMENTS = "WITH s AS (SELECT l_suppkey AS seg, min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS c FROM lineitem GROUP BY 1)"


def segments(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seg")).agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"), F.count("*").alias("c"))


@query(_SEGMENTS + " SELECT min(hi) AS frontier, count(*) AS segments FROM s", "")
def st_02_final_prefix(spark, d):
    """Up to where everything is final: the least end of all segments."""
    return segments(spark, d).agg(F.min("hi").alias("frontier"), F.count("*").alias("segments"))


@query("WITH u AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 5), i AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM u) SELECT min(k) AS f0, max(k) AS f1, count(*) AS len FROM i GROUP BY g", "")
def st_03_final_runs(spark, d):
    """Runs of orders of which some line is final."""
    u = table(spark, d, "lineitem").filter("l_quantity > 5").select(F.col("l_orderkey").alias("n")).distinct()
    return _merged(u)


def _merged(u):
    """Islands found chunk by chunk: a run starts where the number before is missing; its end is the last before the next start."""
    rows = halo(u, 1, 1)
    w = near()
    marked = owned(rows.withColumns({"first": ~F.coalesce(F.lag("n").over(w) == F.col("n") - 1, F.lit(False)), "last": ~F.coalesce(F.lead("n").over(w) == F.col("n") + 1, F.lit(False))}), "n", "first", "last")
    ends = marked.filter("first OR last").withColumn("_k", F.when(F.col("first"), F.col("n")))
    by = Window.orderBy("n")
    run = ends.withColumn("f0", F.last("_k", True).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("last")
    return run.select("f0", F.col("n").alias("f1"), (F.col("n") - F.col("f0") + 1).alias("len"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_partkey % 100 < l_suppkey), r AS (SELECT 90 AS node UNION SELECT b FROM r JOIN e ON a = node)
SELECT CAST(node AS BIGINT) AS node FROM r""", "")
def st_05_closure(spark, d):
    """All segments that a segment needs, directly or not."""
    ready(spark)
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).filter("b < a").distinct()
    return planning.reachable(e, spark.range(90, 91).select(F.col("id").alias("node")))


@query(_SEGMENTS + ", r AS (SELECT seg, hi - lo AS cost, abs(lo - 3000) AS away FROM s) SELECT seg, cost, away FROM r ORDER BY away, cost, seg LIMIT 5", "")
def st_06_seek_point(spark, d):
    """The five segments nearest to a position, cheapest first among equals."""
    return segments(spark, d).select("seg", (F.col("hi") - F.col("lo")).alias("cost"), F.abs(F.col("lo") - 3000).alias("away")).orderBy("away", "cost", "seg").limit(5)


@query("SELECT l_suppkey AS seg, min(l_orderkey) AS lo, max(l_orderkey) FILTER (l_linestatus = 'F') AS final FROM lineitem GROUP BY 1", "")
def st_07_progress(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seg")).agg(F.min("l_orderkey").alias("lo"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_orderkey"))).alias("final"))


@query("""WITH b AS (SELECT n // 64 AS b, min(n) AS start, count(*) AS c FROM sig WHERE n % 640 <> 3 GROUP BY 1), p AS (SELECT *, lag(start + c) OVER (ORDER BY b) AS expected FROM b)
SELECT count(*) AS blocks, count(*) FILTER (expected IS NOT NULL AND expected <> start) AS problems FROM p""")
def st_10_integrity(spark, d):
    """Blocks that don't begin where the one before ended."""
    b = mono(spark, d).filter("n % 640 <> 3").groupBy(div("n", 64).alias("b")).agg(F.min("n").alias("start"), F.count("*").alias("c"))
    p = owned(halo(b, 1, 0, n="b").withColumn("expected", F.lag(F.col("start") + F.col("c")).over(near("b"))), "b", "start", "expected")
    return p.agg(F.count("*").alias("blocks"), F.count_if(F.col("expected") != F.col("start")).alias("problems"))


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40", "")
def st_10_missing(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").filter("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")

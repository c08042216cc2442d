"""Queries that compare signals, and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare
from ..operators.signals import by_user, div, halo, mono, near, owned, stereo, table
from .registry import query

_PAIR = "WITH p AS (SELECT n, x, ((x + 512) >> 10) << 10 AS y, x - (((x + 512) >> 10) << 10) AS e FROM sig)"


def coarse(spark, d):
    """The mono signal beside itself rounded to 1024s."""
    s = mono(spark, d)
    return compare.pair(s, s.withColumn("x", F.shiftleft(F.shiftright(F.col("x") + 512, 10), 10)))


@query(_PAIR + " SELECT n // 64 AS f, round(10 * log10(sum(CAST(e * e AS DOUBLE)) / (count(*) * 5000.0)), 6) AS nmr FROM p GROUP BY 1")
def qm_02_frame_nmr(spark, d):
    return coarse(spark, d).groupBy(div("n", 64).alias("f")).agg(F.round(10 * F.log10(compare.energy("e").cast("double") / (F.count("*") * F.lit(5000.0))), 6).alias("nmr"))


@query(_PAIR + """, f AS (SELECT n // 64 AS f, n % 8 AS region, 10 * log10(sum(CAST(e * e AS DOUBLE)) / (count(*) * 80000.0) + 1e-9) AS nmr FROM p GROUP BY ALL)
SELECT region, round(max(nmr), 6) AS worst, round(avg(nmr), 6) AS mean, round(100.0 * count(*) FILTER (nmr > 0) / count(*), 6) AS over FROM f GROUP BY region""")
def qm_03_regions(spark, d):
    f = coarse(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 8).alias("region")).agg((10 * F.log10(compare.energy("e").cast("double") / (F.count("*") * F.lit(80000.0)) + 1e-9)).alias("nmr"))
    return f.groupBy("region").agg(F.round(F.max("nmr"), 6).alias("worst"), F.round(F.avg("nmr"), 6).alias("mean"), F.round(100.0 * F.count_if(F.col("nmr") > 0) / F.count("*"), 6).alias("over"))


@query(_PAIR + " SELECT round(10 * log10(CAST(sum(x * x) AS DOUBLE) / CAST(sum(e * e) AS DOUBLE)), 6) AS snr, max(abs(e)) AS maxdiff FROM p")
def qm_04_snr(spark, d):
    return compare.snr(coarse(spark, d))


_ATTACKS = _PAIR + """, k AS (SELECT n // 16 AS b, sum(x * x) AS ex, sum(e * e) AS ee FROM p GROUP BY 1),
w AS (SELECT b, ex, ee, count(*) OVER v AS c, sum(ex) OVER v AS px, sum(ee) OVER v AS pe FROM k WINDOW v AS (ORDER BY b ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
a AS (SELECT b, round(CASE WHEN pe <= 0 THEN 200 WHEN px <= 0 THEN -200 ELSE 10 * log10(CAST(px AS DOUBLE) / CAST(pe AS DOUBLE)) END, 6) AS pre_snr FROM w WHERE c = 8 AND 8 * ex >= 1.5 * px)"""


@query(_ATTACKS + " SELECT b, pre_snr FROM a")
def qm_05_attacks(spark, d):
    return compare.attacks(coarse(spark, d))


@query(_ATTACKS + " SELECT k.b, a.b AS attack FROM k JOIN a ON k.b BETWEEN a.b - 8 AND a.b - 1 WHERE ee > ex")
def qm_06_ghosts(spark, d):
    return compare.ghosts(coarse(spark, d))


@query(_PAIR + " SELECT n // 1000 AS second, round(abs(avg(e)), 6) AS dc, count(*) FILTER (x > 20000) AS tops, count(*) FILTER (n % 128 < 8 AND abs(e) > 400) AS at_border FROM p GROUP BY 1")
def qm_07_beyond(spark, d):
    return coarse(spark, d).groupBy(div("n", 1000).alias("second")).agg(F.round(F.abs(F.avg("e")), 6).alias("dc"), F.count_if(F.col("x") > 20000).alias("tops"), F.count_if(F.expr("n % 128 < 8 AND abs(e) > 400")).alias("at_border"))


@query(_PAIR + """, c AS (SELECT n // 1000 AS second, n % 8 AS region, abs(10 * log10(sum(CAST(x * x AS DOUBLE)) + 1) - 10 * log10(sum(CAST(y * y AS DOUBLE)) + 1)) AS off FROM p GROUP BY ALL)
SELECT region, round(avg(CASE WHEN off > 0.01 THEN 1.0 ELSE 0 END), 6) AS over, round(max(off), 6) AS worst FROM c GROUP BY region""")
def qm_08_levels(spark, d):
    db = lambda c: 10 * F.log10(compare.energy(c).cast("double") + 1)
    c = coarse(spark, d).groupBy(div("n", 1000).alias("second"), (F.col("n") % 8).alias("region")).agg(F.abs(db("x") - db("y")).alias("off"))
    return c.groupBy("region").agg(F.round(F.avg(F.when(F.col("off") > 0.01, 1.0).otherwise(0.0)), 6).alias("over"), F.round(F.max("off"), 6).alias("worst"))


@query("""WITH s AS (SELECT user_id, n, x < 800 AS hole, lag(x < 800) OVER (PARTITION BY user_id ORDER BY n) AS before, x FROM sigu)
SELECT user_id, round(stddev_pop(x), 4) AS warble, count(*) FILTER (hole) AS holes, count(*) FILTER (hole <> before) AS flips FROM s GROUP BY user_id""", "sigu")
def qm_09_warble(spark, d):
    w = Window.partitionBy("user_id").orderBy("n")
    s = by_user(spark, d).withColumn("hole", F.col("x") < 800).withColumn("flip", F.lag("hole").over(w) != F.col("hole"))
    return s.groupBy("user_id").agg(F.round(F.stddev_pop("x"), 4).alias("warble"), F.count_if("hole").alias("holes"), F.count_if("flip").alias("flips"))


@query("""SELECT n // 256 AS f, round(10 * log10((sum(CAST(l * l AS DOUBLE)) + 1) / (sum(CAST(r * r AS DOUBLE)) + 1)), 6) AS ild,
round(abs(sum(CAST(l * r AS DOUBLE))) / sqrt(sum(CAST(l * l AS DOUBLE)) * sum(CAST(r * r AS DOUBLE)) + 1), 6) AS coherence FROM sig2 GROUP BY 1""", "sig2")
def qm_10_image(spark, d):
    e = lambda a, b: F.sum((F.col(a) * F.col(b)).cast("double"))
    return stereo(spark, d).groupBy(div("n", 256).alias("f")).agg(F.round(10 * F.log10((e("l", "l") + 1) / (e("r", "r") + 1)), 6).alias("ild"), F.round(F.abs(e("l", "r")) / F.sqrt(e("l", "l") * e("r", "r") + 1), 6).alias("coherence"))


@query(_PAIR + """, c AS (SELECT n // 256 AS f, n % 8 AS b, sum(CAST(e * e AS DOUBLE)) AS e, 21.4 * log10(0.00437 * (n % 8 * 1000 + 500) + 1) AS w FROM p GROUP BY ALL)
SELECT f, round(sum(w * (power(0.5 + 0.5 * e / 1000000.0, 0.23) - 1)) / sum(w), 6) AS score FROM c GROUP BY f""")
def qm_11_weighted(spark, d):
    c = coarse(spark, d).groupBy(div("n", 256).alias("f"), (F.col("n") % 8).alias("b")).agg(compare.energy("e").cast("double").alias("e"))
    w = 21.4 * F.log10(0.00437 * (F.col("b") * 1000 + 500) + 1)
    return c.withColumn("w", w).groupBy("f").agg(F.round(F.sum(F.col("w") * (F.pow(0.5 + 0.5 * F.col("e") / 1000000.0, F.lit(0.23)) - 1)) / F.sum("w"), 6).alias("score"))


@query(_PAIR + ", f AS (SELECT n // 64 AS f, sum(CAST(e * e AS DOUBLE)) / count(*) AS nmr FROM p GROUP BY 1) SELECT max(nmr) <= 262144 AS passed, round(max(nmr), 4) AS worst FROM f")
def qm_14_verdict(spark, d):
    f = coarse(spark, d).groupBy(div("n", 64).alias("f")).agg((compare.energy("e").cast("double") / F.count("*")).alias("nmr"))
    return f.agg((F.max("nmr") <= 262144).alias("passed"), F.round(F.max("nmr"), 4).alias("worst"))


@query("SELECT l_linenumber % 3 AS n_sources, count(*) AS blocks, CAST(sum(l_quantity) AS BIGINT) AS frames, CAST(sum(l_quantity * l_linenumber) AS BIGINT) AS bytes FROM lineitem GROUP BY 1", "")
def cm_04_info_by_type(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_linenumber") % 3).alias("n_sources")).agg(F.count("*").alias("blocks"), F.sum("l_quantity").cast("long").alias("frames"), F.sum(F.col("l_quantity") * F.col("l_linenumber")).cast("long").alias("bytes"))


@query("""WITH f AS (SELECT n // 64 AS f, avg(x) AS m FROM sig GROUP BY 1), k AS (SELECT f * 100 // (SELECT max(f) + 1 FROM f) AS col, CASE WHEN m > 9000 THEN 'A' WHEN m > 7500 THEN 'R' ELSE 'r' END AS c FROM f),
g AS (SELECT col, c, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT col, arg_max(c, (n, c)) AS c FROM g GROUP BY col) SELECT string_agg(c, '' ORDER BY col) AS line FROM b""")
def cm_06_timeline(spark, d):
    """A line of 100 characters: the commonest class of the frames under each."""
    f = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.avg("x").alias("m"))
    top = f.agg((F.max("f") + 1).alias("top"))
    k = f.crossJoin(F.broadcast(top)).select(F.floor(F.col("f") * 100 / F.col("top")).alias("col"), F.when(F.col("m") > 9000, "A").when(F.col("m") > 7500, "R").otherwise("r").alias("c"))
    b = k.groupBy("col", "c").agg(F.count("*").alias("n")).groupBy("col").agg(F.max_by("c", F.struct("n", "c")).alias("c"))
    return b.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "c"))), lambda p: p["c"]), "").alias("line"))


@query("SELECT l_orderkey AS start, CAST(l_quantity AS BIGINT) AS len, l_partkey AS source, l_orderkey - l_partkey AS lag FROM lineitem WHERE l_quantity >= 49 AND l_orderkey > l_partkey", "")
def cm_07_patterns(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity >= 49 AND l_orderkey > l_partkey")
    return li.select(F.col("l_orderkey").alias("start"), F.col("l_quantity").cast("long").alias("len"), F.col("l_partkey").alias("source"), (F.col("l_orderkey") - F.col("l_partkey")).alias("lag"))


@query("""SELECT '{"samples":' || count(*) || ',"peak":' || max(x) || ',"sum":' || sum(x) || '}' AS json FROM sig""")
def cm_08_statistics_json(spark, d):
    return mono(spark, d).agg(F.to_json(F.struct(F.count("*").alias("samples"), F.max("x").alias("peak"), F.sum("x").alias("sum"))).alias("json"))


@query("""WITH e AS (SELECT n // 64 AS f, 10 * log10(sum(x * x) + 1.0) AS e FROM sig GROUP BY 1), p AS (SELECT abs(e - lag(e) OVER (ORDER BY f)) AS d FROM e)
SELECT round(avg(CASE WHEN d < 0.2 THEN 1.0 ELSE 0 END), 6) AS under_02, round(avg(CASE WHEN d < 0.5 THEN 1.0 ELSE 0 END), 6) AS under_05, round(avg(CASE WHEN d < 1 THEN 1.0 ELSE 0 END), 6) AS under_1 FROM p WHERE d IS NOT NULL""")
def cm_09_shares(spark, d):
    e = mono(spark, d).groupBy(div("n", 64).alias("f")).agg((10 * F.log10(F.sum(F.col("x") * F.col("x")) + 1.0)).alias("e"))
    p = owned(halo(e, 1, 0, n="f").withColumn("d", F.abs(F.col("e") - F.lag("e").over(near("f")))), "d").filter("d IS NOT NULL")
    share = lambda x: F.round(F.avg(F.when(F.col("d") < x, 1.0).otherwise(0.0)), 6)
    return p.agg(share(0.2).alias("under_02"), share(0.5).alias("under_05"), share(1).alias("under_1"))

"""Queries of the search for earlier material."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import planning, similarity
from ..operators.signals import div, fingerprints, mono, stereo
from ..sources.shared import ready
from .registry import query

_KNN = """WITH d AS (SELECT a.f AS t, b.f AS s, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM fp a JOIN fp b ON b.f + 2 < a.f),
k AS (SELECT t, s, d, CAST(row_number() OVER (PARTITION BY t ORDER BY d, s) AS INTEGER) AS rk FROM d QUALIFY rk <= {k})"""


def candidates(spark, d, k=4):
    return similarity.nearest_earlier(fingerprints(spark, d), k)


@query("SELECT f, round(list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))), 6) AS spread FROM fp", "fp")
def jn_01_mean_removed(spark, d):
    """Fingerprints with their mean removed, as gain-invariant ones are: what is left of them."""
    v = F.transform("v", lambda x: x - F.aggregate("v", F.lit(0.0), lambda s, y: s + y) / F.size("v"))
    return fingerprints(spark, d).select("f", F.round(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y), 6).alias("spread"))


@query("SELECT a.f AS t, b.f AS s, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM fp a JOIN fp b ON b.f = a.f - 3", "fp")
def jn_02_distance(spark, d):
    a = fingerprints(spark, d)
    b = a.select((F.col("f") + 3).alias("f"), F.col("f").alias("s"), F.col("v").alias("u"))
    return a.join(b, "f").select(F.col("f").alias("t"), "s", F.round(similarity.squared_distance("v", "u"), 6).alias("d"))


@query(_KNN.format(k=4) + " SELECT t, s, rk FROM k", "fp")
def jn_03_backward_knn(spark, d):
    return candidates(spark, d).select("t", "s", "rk")


@query("""WITH d AS (SELECT a.f AS t, b.f AS s, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM fp a JOIN fp b ON b.f + 2 < a.f WHERE a.v[1] > 0 AND b.v[1] > 0)
SELECT t, s, CAST(row_number() OVER (PARTITION BY t ORDER BY d, s) AS INTEGER) AS rk FROM d QUALIFY rk <= 3""", "fp")
def jn_04_onset_pool(spark, d):
    """The same among onset frames only."""
    return similarity.nearest_earlier(fingerprints(spark, d), 3, keep=F.element_at("v", 1) > 0).select("t", "s", "rk")


_SECTIONS = """WITH c AS (SELECT f // 16 - o AS w, f, v FROM fp, (SELECT unnest([0, 1]) AS o)), x AS (SELECT w, unnest(range(1, 65)) AS a, unnest(v) AS x FROM c WHERE w >= 0),
m AS (SELECT w, a, round(avg(x), 9) AS m FROM x GROUP BY ALL HAVING count(*) = 32), s AS (SELECT w AS f, list(m ORDER BY a) AS v FROM m GROUP BY w)"""


@query(_SECTIONS + " SELECT f, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS e FROM s", "fp")
def jn_05_section_fp(spark, d):
    return similarity.sections(fingerprints(spark, d)).select("f", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("e"))


@query(_SECTIONS + """, d AS (SELECT a.f AS w, b.f AS u, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM s a JOIN s b ON b.f + 2 < a.f)
SELECT w, u, CAST(row_number() OVER (PARTITION BY w ORDER BY d, u) AS INTEGER) AS rk FROM d QUALIFY rk <= 2""", "fp")
def jn_06_section_knn(spark, d):
    found = similarity.nearest_earlier(similarity.sections(fingerprints(spark, d)), 4).withColumn("d", F.round("d", 6))
    rk = F.row_number().over(Window.partitionBy("t").orderBy("d", "s"))
    return found.withColumn("rk", rk).filter("rk <= 2").select(F.col("t").alias("w"), F.col("s").alias("u"), "rk")


@query("""SELECT n // 256 AS f, CAST(sum(l * r) AS BIGINT) AS xy, CAST(sum(l * l) AS BIGINT) AS xx, CAST(sum(r * r) AS BIGINT) AS yy,
round(sum(l * r) / sqrt(CAST(sum(l * l) AS DOUBLE) * CAST(sum(r * r) AS DOUBLE)), 6) AS ncc FROM sig2 GROUP BY 1""", "sig2")
def jn_07_ncc_gain(spark, d):
    s = stereo(spark, d).groupBy(div("n", 256).alias("f")).agg(F.sum(F.col("l") * F.col("r")).alias("xy"), F.sum(F.col("l") * F.col("l")).alias("xx"), F.sum(F.col("r") * F.col("r")).alias("yy"))
    return s.withColumn("ncc", F.round(F.col("xy") / F.sqrt(F.col("xx").cast("double") * F.col("yy").cast("double")), 6))


@query("""WITH g AS (SELECT DISTINCT n // 128 AS t, (n // 128 - 2) * 128 + 5 AS guess FROM sig WHERE n // 128 >= 3), l AS (SELECT t, unnest(range(guess - 8, guess + 9)) AS o FROM g),
s AS (SELECT t, o, sum(a.x * b.x) AS xy, sum(a.x * a.x) AS xx, sum(b.x * b.x) AS yy FROM l JOIN sig a ON a.n // 128 = t JOIN sig b ON b.n = o + a.n % 128 WHERE o >= 0 AND o + 128 <= t * 128 GROUP BY ALL),
c AS (SELECT t, o, round(CAST(xy AS DOUBLE) / sqrt(CAST(xx AS DOUBLE) * CAST(yy AS DOUBLE)), 6) AS ncc FROM s WHERE xx > 0 AND yy > 0)
SELECT t, arg_max(o, (ncc, -o)) AS "offset", max(ncc) AS ncc FROM c GROUP BY t""")
def jn_08_align(spark, d):
    s = mono(spark, d)
    g = s.select(div("n", 128).alias("t")).filter("t >= 3").distinct().withColumn("guess", (F.col("t") - 2) * 128 + 5)
    return similarity.align(s, g, 128, 8).drop("guess")


@query(_KNN.format(k=4) + " SELECT a.t, a.s, b.s AS prev_s FROM k a JOIN k b ON b.t = a.t - 1 AND b.s = a.s - 1", "fp")
def jn_10_continuation(spark, d):
    """A pair is there itself and as the one that goes on from the pair before; the search runs once, where a self-join would run it twice."""
    both = F.array(*(F.struct((F.col("t") + k).alias("t"), (F.col("s") + k).alias("s"), F.lit(k).alias("onward")) for k in (0, 1)))
    pairs = candidates(spark, d).select(F.inline(both)).groupBy("t", "s").agg(F.min("onward").alias("lo"), F.max("onward").alias("hi"))
    return pairs.filter("lo < hi").select("t", "s", (F.col("s") - 1).alias("prev_s"))


@query(_KNN.replace("WITH d", "WITH RECURSIVE d").format(k=1) + """, r AS (SELECT t, s AS root FROM k UNION SELECT r.t, k.s FROM r JOIN k ON k.t = r.root) SELECT t, min(root) AS root FROM r GROUP BY t""", "fp")
def jn_11_star_redirect(spark, d):
    ready(spark)
    return similarity.roots(candidates(spark, d, 1).checkpoint())


@query(_KNN.format(k=3) + " SELECT a.t, a.s AS s0, b.s AS s1 FROM k a JOIN k b ON a.t = b.t AND a.rk < b.rk", "fp")
def jn_12_pairs(spark, d):
    c = candidates(spark, d, 3).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("rk", "s"))).alias("c"))
    pair = F.explode(F.flatten(F.transform("c", lambda a: F.transform(F.filter("c", lambda b: b["rk"] > a["rk"]), lambda b: F.struct(a["s"].alias("s0"), b["s"].alias("s1"))))))
    return c.select("t", pair.alias("p")).select("t", "p.s0", "p.s1")


@query(_KNN.format(k=4) + ", u AS (SELECT t, s, rk AS cost FROM k UNION ALL SELECT t + 1, s + 1, rk + 1 FROM k) SELECT t, s, CAST(min(cost) AS INTEGER) AS cost FROM u GROUP BY ALL", "fp")
def jn_13_dedup(spark, d):
    both = F.array(*(F.struct((F.col("t") + k).alias("t"), (F.col("s") + k).alias("s"), (F.col("rk") + k).alias("cost")) for k in (0, 1)))
    return candidates(spark, d).select(F.inline(both)).groupBy("t", "s").agg(F.min("cost").alias("cost"))


@query(_KNN.format(k=1) + """, o AS (SELECT t, s, unnest(range(greatest((4 * s + 4) // 4 - 1, 0), (4 * s + 11) // 4 + 1)) AS f FROM (SELECT t, s FROM k)) SELECT f, count(*) AS uses FROM o GROUP BY f""", "fp")
def jn_14_overlap_uses(spark, d):
    """How many chosen windows of two hops overlap each frame."""
    c = candidates(spark, d, 1)
    return c.select(F.explode(planning.overlap_frames(F.col("s") * 4, 4)).alias("f")).groupBy("f").agg(F.count("*").alias("uses"))


@query("""WITH m AS (SELECT n AS mark, x AS value FROM sig WHERE x % 7 = 0) SELECT s.n, m.mark, m.value FROM sig s ASOF LEFT JOIN m ON s.n >= m.mark""")
def jn_15_as_of(spark, d):
    """For each sample the last one at or before it that divides by seven."""
    s = mono(spark, d)
    return planning.as_of(s.select("n"), s.filter("x % 7 = 0").select(F.col("n").alias("mark"), F.col("x").alias("value")))


@query(_KNN.format(k=2) + " SELECT DISTINCT t // 16 AS seg, s // 16 AS dep FROM k WHERE s // 16 <> t // 16", "fp")
def jn_16_segment_deps(spark, d):
    return candidates(spark, d, 2).select(div("t", 16).alias("seg"), div("s", 16).alias("dep")).filter("seg <> dep").distinct()


@query("""WITH f AS (SELECT n // 64 AS f, n % 4 AS region, sum(l * r) AS xy, sum(r * r) AS yy FROM sig2 GROUP BY ALL)
SELECT f, region, CAST(floor(CAST(xy AS DOUBLE) / yy * 2 + 0.5) AS BIGINT) AS g FROM f WHERE yy > 0""", "sig2")
def jn_24_region_gains(spark, d):
    s = stereo(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 4).alias("region")).agg(F.sum(F.col("l") * F.col("r")).alias("xy"), F.sum(F.col("r") * F.col("r")).alias("yy"))
    return s.filter("yy > 0").select("f", "region", F.floor(F.col("xy").cast("double") / F.col("yy") * 2 + 0.5).cast("long").alias("g"))


_REPEATS = """WITH w AS (SELECT n // 64 AS f, list(CAST(x AS DOUBLE) ORDER BY n) AS v FROM sig GROUP BY 1 HAVING count(*) = 64),
p AS (SELECT a.f AS t, b.f AS s, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS ncc FROM w a JOIN w b ON b.f + 2 <= a.f),
b AS (SELECT t, arg_max(s, (ncc, -s)) AS s, max(ncc) AS ncc FROM p GROUP BY t)"""


@query(_REPEATS + ", g AS (SELECT t - s AS lag, t, ncc, t - row_number() OVER (PARTITION BY t - s ORDER BY t) AS g FROM b) SELECT lag, min(t) AS f0, max(t) AS f1, count(*) AS len, round(max(ncc), 6) AS ncc FROM g GROUP BY lag, g")
def sx_01_repeat_map(spark, d):
    """The flagship: for each frame of 64 the earlier frame it correlates with best, as runs of one lag."""
    best = similarity.frame_match(mono(spark, d), 64)
    w = Window.partitionBy("lag").orderBy("t")
    r = best.withColumn("lag", F.col("t") - F.col("s")).withColumn("_run", F.col("t") - F.row_number().over(w))
    return r.groupBy("lag", "_run").agg(F.min("t").alias("f0"), F.max("t").alias("f1"), F.count("*").alias("len"), F.round(F.max("ncc"), 6).alias("ncc")).drop("_run")

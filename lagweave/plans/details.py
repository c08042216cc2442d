"""Queries of the smaller rules: gates, threshold details, candidate bookkeeping, lookups and guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.kernels import BANDWIDTH_HZ, OFFSET_DB
from ..operators.signals import by_user, div, fingerprints, halo, mono, near, owned, stereo, table
from ..operators.similarity import depths, squared_distance
from ..sources.shared import ready
from .registry import query
from .search import _KNN, candidates


@query("SELECT user_id, bool_and(x % 4 = 0) AS exact, count(*) FILTER (WHERE x % 4 = 0) AS on_grid, count(*) AS samples, round(count(*) / 44.0, 6) AS seconds FROM sigu GROUP BY 1", "sigu")
def src_03_exactness(spark, d):
    return by_user(spark, d).groupBy("user_id").agg(F.bool_and(F.col("x") % 4 == 0).alias("exact"), F.count_if(F.col("x") % 4 == 0).alias("on_grid"), F.count("*").alias("samples"), F.round(F.count("*") / F.lit(44.0), 6).alias("seconds"))


@query("SELECT n, CAST(greatest(least(floor(x * 3.3 + 0.5), 32767), -32768) AS BIGINT) AS s16, CAST(greatest(least(floor(x * 3.3 * 256 + 0.5), 8388607), -8388608) AS BIGINT) AS s24 FROM sig")
def snk_01_clamped(spark, d):
    v = F.col("x") * F.lit(3.3)
    return mono(spark, d).select("n", F.greatest(F.least(F.floor(v + 0.5), F.lit(32767)), F.lit(-32768)).cast("long").alias("s16"), F.greatest(F.least(F.floor(v * 256 + 0.5), F.lit(8388607)), F.lit(-8388608)).cast("long").alias("s24"))


@query("SELECT crc, count(*) AS c FROM (SELECT CAST(3421780262 AS BIGINT) AS crc FROM part) GROUP BY 1", "")
def src_11_crc32(spark, d):
    """The checksum's known value, once for each part."""
    return table(spark, d, "part").select(F.crc32(F.lit("123456789").cast("binary")).alias("crc")).groupBy("crc").agg(F.count("*").alias("c"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'image/png' WHEN p_size % 3 = 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM part", "")
def src_14_cover_kind(spark, d):
    name = F.concat(F.lit("Cover"), F.element_at(F.array(F.lit(".PNG"), F.lit(".jpeg"), F.lit(".tiff")), F.col("p_size") % 3 + 1))
    return table(spark, d, "part").select("p_partkey", sc.mime(name).alias("mime"))


_K1 = _KNN.format(k=1)


@query(_KNN.format(k=4) + " SELECT t, s FROM k WHERE s * 128 >= -128 AND s * 128 + 256 <= t * 128 - 128", "fp")
def prj_08_final_sources(spark, d):
    """Candidates whose window is final before the target's begins."""
    return candidates(spark, d).filter("s * 128 >= -128 AND s * 128 + 256 <= t * 128 - 128").select("t", "s")


@query(_KNN.format(k=4) + " SELECT t, s FROM k WHERE t // 64 = s // 64", "fp")
def prj_09_same_segment(spark, d):
    return candidates(spark, d).filter("t div 64 = s div 64").select("t", "s")


@query("SELECT n // 64 AS f, n % 64 AS b FROM sig WHERE x > 15000 AND (n % 64) * 344 <= 16000")
def prj_12_audible_cells(spark, d):
    """Cells above a threshold, in bands below the quality's bandwidth."""
    return mono(spark, d).select(div("n", 64).alias("f"), (F.col("n") % 64).alias("b"), "x").filter("x > 15000 AND b * 344 <= 16000").select("f", "b")


@query("""SELECT CAST(q AS BIGINT) AS q, ([12, 12, 9, 7, 5, 3, 1.5::DOUBLE, 0, -2, -4, -6])[q + 1] AS offset_db, CAST(([11000, 11000, 12000, 13000, 14000, 15000, 16000, 19000, 19500, 20000, 20500])[q + 1] AS INTEGER) AS hz
FROM (SELECT unnest(range(11)) AS q)""", "")
def psy_05_quality_table(spark, d):
    at = lambda v, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in v)), (F.col("id") + 1).cast("int"))
    return spark.range(11).select(F.col("id").alias("q"), at(OFFSET_DB, "double").alias("offset_db"), at(BANDWIDTH_HZ, "int").alias("hz"))


@query("SELECT n, least(l, r) / 2.0 AS thr, CASE WHEN l <= 0 THEN -200 ELSE round(10 * log10(CAST(l AS DOUBLE) / (r + 1)), 6) END AS nmr FROM sig2", "sig2")
def psy_12_stereo_threshold(spark, d):
    return stereo(spark, d).select("n", (F.least("l", "r") / F.lit(2.0)).alias("thr"), F.when(F.col("l") <= 0, -200.0).otherwise(F.round(10 * F.log10(F.col("l").cast("double") / (F.col("r") + 1)), 6)).alias("nmr"))


@query("""WITH w AS (SELECT n // 128 AS f, (n % 128) // 32 AS w, CAST(sum(x * x) AS DOUBLE) AS e FROM sig GROUP BY ALL)
SELECT f, round(min(e * CASE WHEN w IN (1, 2) THEN 2 ELSE 8 END), 2) AS thr, round(max(e) / avg(e), 6) AS crest FROM w GROUP BY f""")
def psy_14_sub_windows(spark, d):
    """The least of weighted sub-window energies, and how far the loudest is above their mean."""
    w = mono(spark, d).groupBy(div("n", 128).alias("f"), F.expr("(n % 128) div 32").alias("w")).agg(F.sum(F.col("x") * F.col("x")).cast("double").alias("e"))
    return w.groupBy("f").agg(F.round(F.min(F.col("e") * F.when(F.col("w").isin(1, 2), 2).otherwise(8)), 2).alias("thr"), F.round(F.max("e") / F.avg("e"), 6).alias("crest"))


@query("WITH e AS (SELECT n // 64 AS f, CAST(sum(x * x) AS DOUBLE) AS e FROM sig GROUP BY 1) SELECT f, round(e * CASE WHEN f = 0 OR f = (SELECT max(f) FROM e) THEN 0.01 ELSE 1 END, 2) AS thr FROM e")
def psy_16_edges(spark, d):
    """The first and the last frame 20 dB stricter."""
    e = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.sum(F.col("x") * F.col("x")).cast("double").alias("e"))
    top = e.agg(F.max("f").alias("top"))
    return e.crossJoin(F.broadcast(top)).select("f", F.round(F.col("e") * F.when((F.col("f") == 0) | (F.col("f") == F.col("top")), 0.01).otherwise(1.0), 2).alias("thr"))


@query(_K1 + """, p AS (SELECT k.t, k.s, unnest(range(1, 65)) AS i, unnest(a.v) AS x, unnest(b.v) AS y FROM k JOIN fp a ON a.f = k.t JOIN fp b ON b.f = k.s)
SELECT t, round(sqrt(sum(CASE WHEN i <= 32 THEN 1 ELSE 2 END * (x - y) * (x - y)) / 96), 6) AS d FROM p GROUP BY t""", "fp")
def jn_17_weighted_distance(spark, d):
    """The distance to the best source with the upper half of the description weighing double."""
    fp = fingerprints(spark, d)
    c = candidates(spark, d, 1).select("t", "s")
    both = c.join(fp.select(F.col("f").alias("t"), F.col("v").alias("a")), "t").join(fp.select(F.col("f").alias("s"), F.col("v").alias("b")), "s")
    terms = F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))
    total = F.aggregate(F.transform(terms, lambda v, i: F.when(i < 32, v).otherwise(2 * v)), F.lit(0.0), lambda s, v: s + v)
    return both.select("t", F.round(F.sqrt(total / 96), 6).alias("d"))


@query("""WITH s AS (SELECT f, (f * 1103515245 + 12345) % 2147483648 % greatest(f - 4, 1) AS g FROM fp WHERE f >= 8) SELECT s.f, g, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d
FROM s JOIN fp a ON a.f = s.f JOIN fp b ON b.f = g""", "fp")
def jn_21_random_pairs(spark, d):
    """Reference pairs picked by a congruence of the frame's number: the same in every run."""
    fp = fingerprints(spark, d)
    s = fp.filter("f >= 8").withColumn("g", F.expr("(f * 1103515245 + 12345) % 2147483648 % greatest(f - 4, 1)"))
    return s.join(fp.select(F.col("f").alias("g"), F.col("v").alias("u")), "g").select("f", "g", F.round(squared_distance("v", "u"), 6).alias("d"))


@query("WITH r AS (SELECT DISTINCT l_suppkey AS a, l_suppkey + l_linenumber AS b FROM lineitem) SELECT x.a, x.b, min(y.a) AS root FROM r x JOIN r y ON y.a <= x.a AND x.b <= y.b AND y.a >= x.a - 7 GROUP BY ALL", "")
def jn_23_containment(spark, d):
    """Runs inside earlier runs: each is dealt to the few places a run that holds it can begin at, an equi-join."""
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("b")).distinct()
    dealt = r.withColumn("start", F.explode(F.sequence(F.col("a") - 7, F.col("a"))))
    y = r.select(F.col("a").alias("start"), F.col("b").alias("end"))
    return dealt.join(y, "start").filter("b <= end").groupBy("a", "b").agg(F.min("start").alias("root"))


@query(_KNN.format(k=4) + ", r AS (SELECT t, s, CAST(row_number() OVER (PARTITION BY t ORDER BY d DESC, s) AS INTEGER) AS r FROM k) SELECT t + 1 AS t, s + 1 AS s, r AS rk FROM r WHERE r <= 2", "fp")
def pl_03_continuations(spark, d):
    """Each frame's candidates carried to the next frame, two of them."""
    rk = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("d"), "s"))
    return candidates(spark, d).withColumn("rk", rk).filter("rk <= 2").select((F.col("t") + 1).alias("t"), (F.col("s") + 1).alias("s"), "rk")


@query(_K1.replace("WITH d", "WITH RECURSIVE d") + """, g AS (SELECT t, s FROM k), c AS (SELECT t, CAST(1 AS BIGINT) AS depth, s FROM g UNION ALL SELECT c.t, c.depth + 1, g.s FROM c JOIN g ON g.t = c.s)
SELECT t, max(depth) AS depth FROM c GROUP BY t""", "fp")
def pl_13_depth(spark, d):
    """How long each frame's chain of references is, over all frames' links."""
    ready(spark)
    return depths(candidates(spark, d, 1).select("t", "s"))


@query("SELECT n // 64 AS f, n % 8 AS region, round(10 * log10((sum(CAST(l * l AS DOUBLE)) + 1) / (sum(CAST((l - r) * (l - r) AS DOUBLE)) + 1)), 6) AS gain FROM sig2 GROUP BY ALL", "sig2")
def pl_14_prediction_gain(spark, d):
    left, e = F.col("l"), F.col("l") - F.col("r")
    s = stereo(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 8).alias("region"))
    return s.agg(F.round(10 * F.log10((F.sum((left * left).cast("double")) + 1) / (F.sum((e * e).cast("double")) + 1)), 6).alias("gain"))


@query(_K1 + ", u AS (SELECT s AS f, count(*) AS uses FROM k GROUP BY s) SELECT fp.f, COALESCE(uses, 0) AS uses, round(power(1 + COALESCE(uses, 0), -2.0), 6) AS scale FROM fp LEFT JOIN u USING (f)", "fp")
def pl_21_importance(spark, d):
    """Frames that others refer to are kept cleaner: one level of importance as a scale of their thresholds."""
    u = candidates(spark, d, 1).groupBy(F.col("s").alias("f")).agg(F.count("*").alias("uses"))
    rows = fingerprints(spark, d).select("f").join(u, "f", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return rows.withColumn("scale", F.round(F.pow(1 + F.col("uses"), F.lit(-2.0)), 6))


@query(_K1 + " SELECT CASE WHEN d < 1.2 THEN 1 WHEN d < 1.5 THEN 2 ELSE 3 END AS depth, count(*) AS frames FROM k GROUP BY 1", "fp")
def ag_05_depth_histogram(spark, d):
    return candidates(spark, d, 1).groupBy(F.when(F.col("d") < 1.2, 1).when(F.col("d") < 1.5, 2).otherwise(3).alias("depth")).agg(F.count("*").alias("frames"))


@query("""SELECT n, CAST(least(greatest(x * 1000000, -2147483648), 2147483647) AS BIGINT) AS sat, CAST(least(greatest(x, -32768), 32767) AS BIGINT) AS s16, x >> 3 AS shifted FROM sig""")
def fn_10_saturating(spark, d):
    x = F.col("x")
    return mono(spark, d).select("n", F.least(F.greatest(x * 1_000_000, F.lit(-(1 << 31))), F.lit((1 << 31) - 1)).cast("long").alias("sat"), F.least(F.greatest(x, F.lit(-32768)), F.lit(32767)).cast("long").alias("s16"), F.shiftright(x, 3).alias("shifted"))


@query("SELECT CAST(k AS BIGINT) AS k, CAST(floor(4096 / (1 + exp(-k / 256.0)) + 0.5) AS BIGINT) AS squash FROM (SELECT unnest(range(-2047, 2048, 13)) AS k)", "")
def fn_13_squash(spark, d):
    return spark.range(-2047, 2048, 13).select(F.col("id").alias("k"), F.floor(4096 / (1 + F.exp(-F.col("id") / F.lit(256.0))) + 0.5).cast("long").alias("squash"))


@query("SELECT n, CASE WHEN n % 512 < 100 THEN n % 512 ELSE (n % 512) // CAST(power(2, floor(log2((n % 512) / 100.0)) + 1) AS BIGINT) END AS source FROM sig")
def fn_19_source_bin(spark, d):
    """The place below the crossover that an octave copy reads."""
    k = F.col("n") % 512
    halves = F.floor(F.log2(k / F.lit(100.0))) + 1
    return mono(spark, d).select("n", F.when(k < 100, k).otherwise(F.floor(k / F.pow(F.lit(2.0), halves))).cast("long").alias("source"))


@query("SELECT p_partkey, COALESCE(TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT), -1) AS level, p_brand IN ('Brand#11', 'Brand#22') OR p_type LIKE 'STANDARD%' AS internal FROM part", "")
def fn_24_parsed_names(spark, d):
    p = table(spark, d, "part")
    digits = F.regexp_replace("p_brand", "[^0-9]", "")
    return p.select("p_partkey", F.coalesce(digits.try_cast("long"), F.lit(-1)).alias("level"), (F.col("p_brand").isin("Brand#11", "Brand#22") | F.col("p_type").startswith("STANDARD")).alias("internal"))


@query("SELECT CAST(k AS BIGINT) AS kbit, CAST(CASE WHEN k < 64 THEN 4000 WHEN k < 96 THEN 6000 WHEN k < 128 THEN 8000 ELSE floor((8000 + (k - 128) * 40) / 250.0 + 0.5) * 250 END AS BIGINT) AS hz FROM (SELECT unnest(range(32, 321, 16)) AS k)", "")
def fn_28_crossover(spark, d):
    k = F.col("id")
    hz = F.when(k < 64, 4000).when(k < 96, 6000).when(k < 128, 8000).otherwise(F.floor((8000 + (k - 128) * 40) / F.lit(250.0) + 0.5) * 250)
    return spark.range(32, 321, 16).select(k.alias("kbit"), hz.cast("long").alias("hz"))


@query("SELECT user_id, max(abs(x)) > 19000 OR count(*) > 60 AS hires FROM sigu GROUP BY 1", "sigu")
def fn_31_profile(spark, d):
    return by_user(spark, d).groupBy("user_id").agg(((F.max(F.abs("x")) > 19000) | (F.count("*") > 60)).alias("hires"))


@query("""WITH c AS (SELECT n // 64 AS f, sum(2.2 + 1.35 * log2(1 + abs(l)) + 2.2 + 1.35 * log2(1 + abs(r))) AS lr, sum(2.2 + 1.35 * log2(1 + abs((l + r) >> 1)) + 2.2 + 1.35 * log2(1 + abs(l - r))) AS ms FROM sig2 GROUP BY 1)
SELECT f, ms < lr AS mid_side FROM c""", "sig2")
def ec_08_mid_side(spark, d):
    bits = lambda c: 2.2 + 1.35 * F.log2(1 + F.abs(c))
    left, right = F.col("l"), F.col("r")
    c = stereo(spark, d).groupBy(div("n", 64).alias("f")).agg(F.sum(bits(left) + bits(right)).alias("lr"), F.sum(bits(F.shiftright(left + right, 1)) + bits(left - right)).alias("ms"))
    return c.select("f", (F.col("ms") < F.col("lr")).alias("mid_side"))


@query("""WITH e AS (SELECT n // 64 AS f, CAST(sum((l - r) * l) AS DOUBLE) AS ep, CAST(sum(l * l) AS DOUBLE) AS pp FROM sig2 GROUP BY 1) SELECT f, round(10 * log10(ep * ep / pp + 1e-9), 6) AS echo FROM e WHERE pp > 0""", "sig2")
def ec_12_echo(spark, d):
    """How much of a prediction is left in the error, in dB."""
    e = stereo(spark, d).groupBy(div("n", 64).alias("f")).agg(F.sum((F.col("l") - F.col("r")) * F.col("l")).cast("double").alias("ep"), F.sum(F.col("l") * F.col("l")).cast("double").alias("pp"))
    return e.filter("pp > 0").select("f", F.round(10 * F.log10(F.col("ep") * F.col("ep") / F.col("pp") + 1e-9), 6).alias("echo"))


@query("SELECT n, l * 3 // 2 + r // 4 AS p, l - (l * 3 // 2 + r // 4) AS res FROM sig2 WHERE l >= 0 AND r >= 0", "sig2")
def ls_05_two_sources(spark, d):
    """A prediction from two sources with gains of 3/2 and 1/4, and what it leaves."""
    p = F.floor(F.col("l") * 3 / F.lit(2.0)).cast("long") + F.floor(F.col("r") / F.lit(4.0)).cast("long")
    return stereo(spark, d).filter("l >= 0 AND r >= 0").select("n", p.alias("p"), (F.col("l") - p).alias("res"))


@query("""WITH e AS (SELECT n // 64 AS f, round(10 * log10(sum(x * x) + 1.0), 6) AS e FROM sig GROUP BY 1), l AS (SELECT f, e, lag(e) OVER (ORDER BY f) AS p FROM e) SELECT f, e - p > 0.3 AS rose, p - e > 0.3 AS fell FROM l WHERE p IS NOT NULL""")
def ls_13_flapping(spark, d):
    """Frames whose level left a band of 0.3 dB around the frame before."""
    e = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.round(10 * F.log10(F.sum(F.col("x") * F.col("x")) + 1.0), 6).alias("e"))
    rows = owned(halo(e, 1, 0, n="f").withColumn("p", F.lag("e").over(near("f"))), "f", "e", "p").filter("p IS NOT NULL")
    return rows.select("f", (F.col("e") - F.col("p") > 0.3).alias("rose"), (F.col("p") - F.col("e") > 0.3).alias("fell"))


@query("""WITH s AS (SELECT l_suppkey AS seg, count(*) AS c, min(l_orderkey) AS lo FROM lineitem GROUP BY 1) SELECT seg, CASE WHEN seg % 10 = 3 THEN 0 WHEN lo < 100 THEN 1 ELSE 2 END AS rank, c FROM s ORDER BY 2, c DESC, seg LIMIT 10""", "")
def st_04_priorities(spark, d):
    """The ten segments that would be decoded next."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seg")).agg(F.count("*").alias("c"), F.min("l_orderkey").alias("lo"))
    return s.select("seg", F.when(F.col("seg") % 10 == 3, 0).when(F.col("lo") < 100, 1).otherwise(2).alias("rank"), "c").orderBy("rank", F.desc("c"), "seg").limit(10)


@query("""WITH c AS (SELECT n // 256 AS f, 10 * log10(sum(CAST(l * l AS DOUBLE)) + 1) - 10 * log10(sum(CAST(r * r AS DOUBLE)) + 1) AS d FROM sig2 WHERE n % 8 >= 4 GROUP BY 1)
SELECT round(avg(abs(d)), 6) AS mean_abs, round(avg(d), 6) AS bias, round(100.0 * count(*) FILTER (abs(d) > 3) / count(*), 6) AS over, round(max(abs(d)), 6) AS worst FROM c""", "sig2")
def qm_12_high_band(spark, d):
    db = lambda c: 10 * F.log10(F.sum((F.col(c) * F.col(c)).cast("double")) + 1)
    c = stereo(spark, d).filter("n % 8 >= 4").groupBy(div("n", 256).alias("f")).agg((db("l") - db("r")).alias("d"))
    return c.agg(F.round(F.avg(F.abs("d")), 6).alias("mean_abs"), F.round(F.avg("d"), 6).alias("bias"), F.round(100.0 * F.count_if(F.abs("d") > 3) / F.count("*"), 6).alias("over"), F.round(F.max(F.abs("d")), 6).alias("worst"))

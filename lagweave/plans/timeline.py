"""Queries of framing, projections, aggregates and positional windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import framing, runs, signals
from ..operators.signals import by_user, div, halo, mono, near, owned, stereo, table
from .registry import query


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS samples, CAST((count(*) + 127) // 128 + 1 AS BIGINT) AS frames FROM sigu GROUP BY user_id", "sigu")
def trf_01_frame_count(spark, d):
    return by_user(spark, d).groupBy("user_id").agg(F.count("*").alias("samples")).withColumn("frames", framing.frame_count(F.col("samples"), 128))


@query("""WITH w AS (SELECT n // 128 AS f, x FROM sig UNION ALL SELECT n // 128 + 1, x FROM sig)
SELECT CAST(f AS BIGINT) AS f, count(*) AS cnt, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(x * x) AS BIGINT) AS energy FROM w GROUP BY f""")
def trf_02_frames(spark, d):
    return framing.frames(mono(spark, d), 128).groupBy("f").agg(F.count("*").alias("cnt"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("energy"))


@query("""WITH g AS (SELECT unnest(range(8)) AS g), f AS (SELECT DISTINCT unnest([n // 1024, n // 1024 + 1]) AS f FROM sig)
SELECT CAST(f AS BIGINT) AS f, CAST(g AS BIGINT) AS g, count(*) AS cnt, CAST(sum(x) AS BIGINT) AS sx
FROM f, g, sig WHERE n >= f * 1024 - 1024 + 448 + 128 * g AND n < f * 1024 - 1024 + 448 + 128 * g + 256 GROUP BY ALL""")
def trf_03_short_windows(spark, d):
    """Eight windows of 256 samples, 128 apart, from place 448 of each frame of two hops of 1024."""
    rows = framing.frames(mono(spark, d), 1024)
    last = F.floor((F.col("i") - 448) / 128).cast("long")
    dealt = rows.withColumn("g", F.explode(F.sequence(last - 1, last))).filter("g BETWEEN 0 AND 7")
    return dealt.groupBy("f", "g").agg(F.count("*").alias("cnt"), F.sum("x").alias("sx"))


@query("""WITH w AS (SELECT unnest(range(5)) AS w), f AS (SELECT DISTINCT unnest([n // 1024, n // 1024 + 1]) AS f FROM sig)
SELECT CAST(f AS BIGINT) AS f, CAST(w AS BIGINT) AS w, count(*) AS cnt, CAST(sum(x * x) AS BIGINT) AS energy
FROM f, w, sig WHERE n >= f * 1024 - 1024 - 512 + 512 * w AND n < f * 1024 - 1024 - 512 + 512 * w + 1024 GROUP BY ALL""")
def trf_04_sub_windows(spark, d):
    """Five windows of 1024 samples, 512 apart, from 512 before each frame."""
    s = mono(spark, d)
    hops = s.withColumn("h", div("n", 512))
    known = s.select(F.explode(F.array(div("n", 1024), div("n", 1024) + 1)).alias("f")).distinct()
    dealt = hops.withColumn("start", F.explode(F.array(F.col("h"), F.col("h") - 1)))  # in hops of 512
    # Window w of frame f begins at hop 2f - 3 + w.
    dealt = dealt.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("twice", F.col("start") + 3 - F.col("w")).filter("twice % 2 = 0 AND twice >= 0")
    dealt = dealt.withColumn("f", F.expr("twice div 2"))
    return dealt.join(known, "f", "left_semi").groupBy("f", F.col("w").cast("long").alias("w")).agg(F.count("*").alias("cnt"), F.sum(F.col("x") * F.col("x")).alias("energy"))


@query("SELECT n, 2 * x AS y, CAST(2 AS BIGINT) AS c FROM sig")
def trf_11_overlap_add(spark, d):
    return framing.overlap_add(framing.frames(mono(spark, d), 128), 128)


@query("SELECT n, l, r, round((l + r) / 2.0, 6) AS m, round((l - r) / 2.0, 6) AS s FROM sig2", "sig2")
def trf_12_mid_side(spark, d):
    return stereo(spark, d).withColumns({"m": F.round((F.col("l") + F.col("r")) / F.lit(2.0).cast("double"), 6), "s": F.round((F.col("l") - F.col("r")) / F.lit(2.0).cast("double"), 6)})


@query("SELECT n // 8 AS k, CAST(sum(x) AS BIGINT) AS s FROM sig GROUP BY 1")
def trf_14_decimate(spark, d):
    return framing.decimate(mono(spark, d))


@query("SELECT n // 32 AS b, round(10 * log10(avg(CAST(x AS DOUBLE) * x) + 1e-10), 6) AS level FROM sig GROUP BY 1")
def trf_15_envelope(spark, d):
    return framing.envelope(mono(spark, d))


@query("SELECT n, CAST(greatest(least(floor(x * 0.37 + 0.5), 32767), -32768) AS BIGINT) AS q FROM sig")
def prj_01_quantise(spark, d):
    return mono(spark, d).select("n", F.greatest(F.least(F.floor(F.col("x") * F.lit(0.37).cast("double") + 0.5), F.lit(32767)), F.lit(-32768)).cast("long").alias("q"))


@query("SELECT n // 64 AS f, CAST(sum(x * x) AS BIGINT) AS energy FROM sig GROUP BY 1 HAVING sum(x * x) < 64 * 30000000")
def prj_02_silent(spark, d):
    return mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.sum(F.col("x") * F.col("x")).alias("energy")).filter(F.col("energy") < 64 * 30_000_000)


_TRANSIENT = """WITH p AS (SELECT n // 256 AS f, (n % 256) // 16 AS part, sum(x * x) AS e FROM sig GROUP BY ALL),
m AS (SELECT f, arg_max(part, (e, -part)) AS part, max(e) AS e_max FROM p GROUP BY f),
t AS (SELECT m.f, m.part, CAST(m.e_max AS BIGINT) AS e_max, CAST(COALESCE(sum(p.e), 0) AS BIGINT) AS pre FROM m LEFT JOIN p ON p.f = m.f AND p.part < m.part GROUP BY ALL)"""


def transients(spark, d):
    """f, part, e_max, pre, is_transient: of 16 parts the loudest, and whether it is over ten times the mean of those before it."""
    p = mono(spark, d).groupBy(div("n", 256).alias("f"), F.expr("(n % 256) div 16").alias("part")).agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    m = p.groupBy("f").agg(F.max(F.struct("e", -F.col("part"))).alias("m"), F.collect_list(F.struct("part", "e")).alias("all"))
    m = m.select("f", (-F.col("m.col2")).alias("part"), F.col("m.e").alias("e_max"), "all")
    pre = F.aggregate(F.filter("all", lambda a: a["part"] < F.col("part")), F.lit(0).cast("long"), lambda s, a: s + a["e"])
    return m.select("f", "part", "e_max", pre.alias("pre")).withColumn("is_transient", (F.col("part") > 0) & (F.col("e_max") * F.col("part") > 10 * F.col("pre")))


@query(_TRANSIENT + " SELECT *, part > 0 AND e_max * part > 10 * pre AS is_transient FROM t")
def prj_03_transient(spark, d):
    return transients(spark, d)


@query("SELECT bit_or(CAST(l_quantity AS BIGINT) * 4) AS bits_or, CAST(2 AS INTEGER) AS wasted FROM lineitem HAVING bit_or(CAST(l_quantity AS BIGINT) * 4) % 8 = 4", "")
def prj_04_wasted_bits(spark, d):
    x = table(spark, d, "lineitem").agg(F.bit_or(F.col("l_quantity").cast("long") * 4).alias("bits_or"))
    return x.withColumn("wasted", (F.length(F.bin("bits_or")) - F.length(F.rtrim(F.bin("bits_or"), F.lit("0")))).cast("int"))


@query("SELECT n, ((x + 4) >> 3) << 3 AS q, x - (((x + 4) >> 3) << 3) AS err FROM sig")
def prj_05_near_lossless(spark, d):
    q = F.shiftleft(F.shiftright(F.col("x") + 4, 3), 3)
    return mono(spark, d).select("n", q.alias("q"), (F.col("x") - q).alias("err"))


@query("SELECT n // 1000 AS second, count(*) FILTER (x > 20000 OR x < -20000) AS over_range, max(abs(x)) AS peak FROM sig GROUP BY 1")
def prj_07_clipping(spark, d):
    return mono(spark, d).groupBy(div("n", 1000).alias("second")).agg(F.count_if(F.expr("x > 20000 OR x < -20000")).alias("over_range"), F.max(F.abs("x")).alias("peak"))


@query("SELECT n // 256 AS f, count(*) AS cnt, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(x * x) AS BIGINT) AS energy, max(abs(x)) AS peak FROM sig GROUP BY 1")
def ag_01_frame_energy(spark, d):
    return framing.frame_energy(mono(spark, d), 256)


@query("SELECT user_id, n // 50 AS second, count(*) AS c, CAST(sum(x) AS BIGINT) AS s, min(x) AS lo, max(x) AS hi FROM sigu GROUP BY ALL", "sigu")
def ag_02_per_second(spark, d):
    return by_user(spark, d).groupBy("user_id", div("n", 50).alias("second")).agg(F.count("*").alias("c"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("""SELECT n // 1000 AS second, n % 8 AS region, round(10 * log10(sum(CAST(l AS DOUBLE) * l) + 1e-9), 6) AS l_db, round(10 * log10(sum(CAST(r AS DOUBLE) * r) + 1e-9), 6) AS r_db
FROM sig2 GROUP BY ALL""", "sig2")
def ag_03_level_table(spark, d):
    db = lambda c: F.round(10 * F.log10(F.sum(F.col(c).cast("double") * F.col(c)) + 1e-9), 6)
    return stereo(spark, d).groupBy(div("n", 1000).alias("second"), (F.col("n") % 8).alias("region")).agg(db("l").alias("l_db"), db("r").alias("r_db"))


_BINS = "CASE WHEN r < 1.5 THEN 0 WHEN r < 2 THEN 1 WHEN r < 4 THEN 2 WHEN r < 8 THEN 3 WHEN r < 16 THEN 4 ELSE 5 END"


@query(f"""WITH f AS (SELECT n // 32 AS f, max(abs(x)) / greatest(avg(abs(x)), 1) AS r FROM sig GROUP BY 1)
SELECT {_BINS} AS b, count(*) AS c FROM f GROUP BY 1""")
def ag_04_ratio_histogram(spark, d):
    f = mono(spark, d).groupBy(div("n", 32).alias("f")).agg((F.max(F.abs("x")) / F.greatest(F.avg(F.abs("x")), F.lit(1.0))).alias("r"))
    return f.groupBy(F.expr(_BINS).alias("b")).agg(F.count("*").alias("c"))


@query("SELECT n // 512 AS f, count(*) FILTER (x > 9000) AS over, round(100.0 * count(*) FILTER (x > 9000) / count(*), 6) AS pct, arg_max(n, (x, -n)) AS worst FROM sig GROUP BY 1")
def ag_06_conditional_counts(spark, d):
    return mono(spark, d).groupBy(div("n", 512).alias("f")).agg(F.count_if(F.expr("x > 9000")).alias("over"), F.round(100.0 * F.count_if(F.expr("x > 9000")) / F.count("*"), 6).alias("pct"), F.max_by("n", F.struct("x", -F.col("n"))).alias("worst"))


@query("SELECT n // 512 AS f, round(sum(CAST(l AS DOUBLE) * r) / nullif(sum(CAST(r AS DOUBLE)), 0), 6) AS wmean FROM sig2 GROUP BY 1", "sig2")
def ag_07_weighted_mean(spark, d):
    return stereo(spark, d).groupBy(div("n", 512).alias("f")).agg(F.round(F.sum(F.col("l").cast("double") * F.col("r")) / F.nullif(F.sum(F.col("r").cast("double")), F.lit(0.0)), 6).alias("wmean"))


@query("""WITH s AS (SELECT user_id, n // 10 AS second, CAST(sum(x) AS BIGINT) AS total FROM sigu GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, second) AS INTEGER) AS rk FROM s QUALIFY rk <= 8""", "sigu")
def ag_08_top_seconds(spark, d):
    s = by_user(spark, d).groupBy("user_id", div("n", 10).alias("second")).agg(F.sum("x").alias("total"))
    return s.withColumn("rk", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("total"), "second"))).filter("rk <= 8")


@query("SELECT user_id, n % 4 AS band, round(stddev_pop(x), 4) AS sd FROM sigu GROUP BY ALL", "sigu")
def ag_09_spread(spark, d):
    return by_user(spark, d).groupBy("user_id", (F.col("n") % 4).alias("band")).agg(F.round(F.stddev_pop("x"), 4).alias("sd"))


@query("""WITH l AS (SELECT a.n, list_sort(list(b.x)) AS v FROM sig a JOIN sig b ON b.n BETWEEN a.n - 6 AND a.n + 6 AND b.n <> a.n GROUP BY a.n)
SELECT n, v[len(v) // 2 + 1] AS med FROM l""")
def ag_10_neighbour_median(spark, d):
    return framing.neighbour_median(mono(spark, d))


@query("SELECT n // 256 AS f, bit_or(x) AS bits FROM sig GROUP BY 1")
def ag_11_bit_or(spark, d):
    return mono(spark, d).groupBy(div("n", 256).alias("f")).agg(F.bit_or("x").alias("bits"))


@query("""WITH l AS (SELECT n, x AS a, COALESCE(lag(x) OVER (ORDER BY n), 0) AS b, COALESCE(lag(x, 2) OVER (ORDER BY n), 0) AS c, COALESCE(lag(x, 3) OVER (ORDER BY n), 0) AS e FROM sig)
SELECT n, a AS r0, a - b AS r1, a - 2 * b + c AS r2, a - 3 * b + 3 * c - e AS r3 FROM l""")
def wn_01_fixed_predictors(spark, d):
    return framing.differences(mono(spark, d))


@query("SELECT n, CAST(sum(x) OVER (ORDER BY n ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING) AS BIGINT) AS s FROM sig")
def wn_02_moving_sum(spark, d):
    return framing.moving_sum(mono(spark, d), 32)


@query("""WITH e AS (SELECT n // 16 AS b, CAST(sum(x * x) AS BIGINT) AS e FROM sig GROUP BY 1),
p AS (SELECT b, e, CAST(sum(e) OVER w AS BIGINT) AS p, count(*) OVER w AS c FROM e WINDOW w AS (ORDER BY b ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT b, e, p FROM p WHERE c = 8 AND 8 * e >= 2 * p""")
def wn_03_attack_blocks(spark, d):
    """Blocks of 16 whose energy is at least twice the mean of the eight before them."""
    e = framing.frame_energy(mono(spark, d), 16).select(F.col("f").alias("b"), F.col("energy").alias("e"))
    w = near("b").rowsBetween(-8, -1)
    return owned(halo(e, 8, 0, n="b").withColumns({"p": F.sum("e").over(w), "c": F.count("*").over(w)}).filter("own AND c = 8 AND 8 * e >= 2 * p"), "b", "e", "p")


@query("SELECT n, x, CAST(sum(x) OVER (ORDER BY n) AS BIGINT) AS run FROM sig")
def wn_04_prefix_sum(spark, d):
    return runs.running_sum(mono(spark, d))


@query("""WITH z AS (SELECT n, x < 10000 AS z, n - row_number() OVER (PARTITION BY x < 10000 ORDER BY n) AS g FROM sig)
SELECT z, min(n) AS f0, max(n) AS f1, count(*) AS len FROM z GROUP BY z, g""")
def wn_05_islands(spark, d):
    return runs.islands(mono(spark, d), F.col("x") < 10000).withColumnRenamed("key", "z")


@query("""WITH z AS (SELECT user_id, (x < 10000) <> lag(x < 10000) OVER (PARTITION BY user_id ORDER BY n) AS flip FROM sigu)
SELECT user_id, count(*) FILTER (flip) AS c FROM z GROUP BY user_id""", "sigu")
def wn_06_toggles(spark, d):
    return runs.toggles(by_user(spark, d), "user_id", F.col("x") < 10000)


@query("""WITH RECURSIVE m AS (SELECT user_id, n, x * 16 AS m FROM sigu WHERE n = 0
UNION ALL SELECT s.user_id, s.n, m.m + ((s.x * 16 - m.m) >> 4) FROM m JOIN sigu s ON s.user_id = m.user_id AND s.n = m.n + 1)
SELECT user_id, n, m FROM m""", "sigu")
def wn_07_running_mean(spark, d):
    """An integer exponential mean along each user's signal: a fold over the samples in order, kept as an array."""
    s = by_user(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda p: p["x"]).alias("v"))
    first = F.array(F.element_at("v", 1) * 16)
    fold = F.aggregate(F.slice("v", F.lit(2), F.greatest(F.size("v") - 1, F.lit(0))), first, lambda m, x: F.concat(m, F.array(F.element_at(m, -1) + F.shiftright(x * 16 - F.element_at(m, -1), 4))))
    return s.select("user_id", F.posexplode(fold).alias("n", "m")).select("user_id", F.col("n").cast("long").alias("n"), "m")


@query("""WITH e AS (SELECT n // 64 AS f, log10(sum(x * x) + 1.0) AS e FROM sig GROUP BY 1), g AS (SELECT f, abs(e - lag(e) OVER (ORDER BY f)) AS g FROM e),
h AS (SELECT f, g, lag(g) OVER (ORDER BY f) AS p FROM g) SELECT count(*) + 1 AS sections FROM h WHERE g > 0.02 AND g > 2 * p""")
def wn_08_novelty(spark, d):
    e = framing.frame_energy(mono(spark, d), 64).select("f", F.log10(F.col("energy") + 1.0).alias("e"))
    w = near("f")
    h = halo(e, 2, 0, n="f").withColumn("g", F.abs(F.col("e") - F.lag("e").over(w))).withColumn("p", F.lag("g").over(w))
    return h.filter("own AND g > 0.02 AND g > 2 * p").agg((F.count("*") + 1).alias("sections"))


@query("""WITH l AS (SELECT n, x - lag(x) OVER (ORDER BY n) AS d FROM sig)
SELECT round(avg(CAST(d AS DOUBLE) * d) FILTER (n % 128 < 8 OR n % 128 >= 120), 2) AS at_border, round(avg(CAST(d AS DOUBLE) * d) FILTER (n % 128 >= 8 AND n % 128 < 120), 2) AS inside FROM l WHERE d IS NOT NULL""")
def wn_09_border(spark, d):
    h = halo(mono(spark, d), 1, 0).withColumn("d", (F.col("x") - F.lag("x").over(near())).cast("double")).filter("own AND d IS NOT NULL")
    at = "n % 128 < 8 OR n % 128 >= 120"
    return h.agg(F.round(F.avg(F.expr(f"CASE WHEN {at} THEN d * d END")), 2).alias("at_border"), F.round(F.avg(F.expr(f"CASE WHEN NOT ({at}) THEN d * d END")), 2).alias("inside"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY doc_id, line) AS BIGINT) AS same FROM sym", "sym")
def jn_00_repeated_lines(spark, d):
    """Lines as frames: how often a line's text occurs in its document."""
    s = signals.symbols(spark, d)
    c = s.groupBy("doc_id", "line").agg(F.count("*").alias("same"))
    return s.join(c, ["doc_id", "line"]).select("doc_id", "i", "same")

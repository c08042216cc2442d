"""Queries of scalar functions, prediction, residual coding and containers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import framing, lossless
from ..operators.signals import by_user, div, halo, mono, near, owned, stereo, table
from .registry import query


@query("SELECT CAST(k AS BIGINT) AS i, round(power(2.0, (k - 48) / 4.0), 6) AS step FROM (SELECT unnest(range(128)) AS k)", "")
def fn_01_steps(spark, d):
    return spark.range(128).select(F.col("id").alias("i"), F.round(sc.step_of(F.col("id")), 6).alias("step"))


@query("SELECT n, CAST(greatest(least(floor(4 * log2(sqrt(12.0 * (x + 1)))) + 48, 127), 0) AS BIGINT) AS sf FROM sig WHERE x >= 0")
def fn_02_scale(spark, d):
    return mono(spark, d).filter("x >= 0").select("n", sc.scale_for(F.col("x") + F.lit(1.0)).alias("sf"))


@query("""WITH g AS (SELECT n, CASE WHEN 20 * log10(greatest(abs(x / 10000.0), 1e-9)) < -36.25 THEN -128 ELSE greatest(least(floor(2 * (20 * log10(greatest(abs(x / 10000.0), 1e-9))) + 0.5), 24), -72) END AS g FROM sig)
SELECT n, CAST(g AS BIGINT) AS idx, round(CASE WHEN g = -128 THEN 0 ELSE power(10.0, g / 40.0) END, 6) AS value FROM g""")
def fn_03_gain(spark, d):
    g = mono(spark, d).select("n", sc.gain_index(F.col("x") / F.lit(10000.0)).alias("idx"))
    return g.withColumn("value", F.round(sc.gain_value(F.col("idx")), 6))


@query("SELECT n, CAST(greatest(least(floor(2 * log2(greatest(CAST(x AS DOUBLE), 1e-9))), 63), 0) AS BIGINT) AS lv FROM sig")
def fn_04_level(spark, d):
    return mono(spark, d).select("n", sc.level_index(F.col("x").cast("double")).alias("lv"))


@query("SELECT CAST(k AS BIGINT) AS i, round(power(2.0, -k / 2.0), 9) AS ratio FROM (SELECT unnest(range(16)) AS k)", "")
def fn_05_fill(spark, d):
    return spark.range(16).select(F.col("id").alias("i"), F.round(sc.fill_ratio(F.col("id")), 9).alias("ratio"))


@query("""SELECT CAST(p AS BIGINT) AS p, round(sqrt(2 * power(10.0, p * 0.15) / (1 + power(10.0, p * 0.15))), 6) AS gl, round(sqrt(2 / (1 + power(10.0, p * 0.15))), 6) AS gr
FROM (SELECT unnest(range(-16, 17)) AS p)""", "")
def fn_06_stereo_gains(spark, d):
    gl, gr = sc.stereo_gains(F.col("id"))
    return spark.range(-16, 17).select(F.col("id").alias("p"), F.round(gl, 6).alias("gl"), F.round(gr, 6).alias("gr"))


@query("""WITH r AS (SELECT n, x - COALESCE(lag(x) OVER (ORDER BY n), 0) AS r FROM sig)
SELECT n, r, CASE WHEN r > 0 THEN 2 * r - 1 ELSE -2 * r END AS u, r AS back FROM r""")
def fn_07_zigzag(spark, d):
    r = framing.differences(mono(spark, d)).select("n", F.col("r1").alias("r")).withColumn("u", sc.zigzag(F.col("r")))
    return r.withColumn("back", sc.unzigzag(F.col("u")))


@query("SELECT n, CASE WHEN x <= 0 THEN 0 ELSE CAST(floor(log2(x)) AS INTEGER) + 1 END AS bits FROM sig WHERE x >= 0")
def fn_08_bit_length(spark, d):
    return mono(spark, d).filter("x >= 0").select("n", sc.bit_length(F.col("x")).alias("bits"))


@query("""WITH r AS (SELECT n, x - COALESCE(lag(x) OVER (ORDER BY n), 0) AS r FROM sig), u AS (SELECT CASE WHEN r > 0 THEN 2 * r - 1 ELSE -2 * r END AS u FROM r)
SELECT CAST(b AS BIGINT) AS b, count(*) AS cnt, CAST(sum((u >> b) & 1) AS BIGINT) AS ones FROM u, (SELECT unnest(range(18)) AS b) GROUP BY b""")
def fn_09_bit_planes(spark, d):
    u = framing.differences(mono(spark, d)).select(sc.zigzag(F.col("r1")).alias("u"))
    planes = u.select(F.explode(F.array(*(F.struct(F.lit(b).cast("long").alias("b"), F.shiftright("u", b).bitwiseAND(1).alias("one")) for b in range(18)))).alias("p"))
    return planes.groupBy("p.b").agg(F.count("*").alias("cnt"), F.sum("p.one").alias("ones"))


@query("SELECT n, CAST(CASE WHEN ((x * 1000003) & 4294967295) >= 2147483648 THEN ((x * 1000003) & 4294967295) - 4294967296 ELSE (x * 1000003) & 4294967295 END AS BIGINT) AS w FROM sig")
def fn_11_wrap(spark, d):
    return mono(spark, d).select("n", sc.wrap32(F.col("x") * 1000003).alias("w"))


@query("""WITH s AS (SELECT n // 256 AS f, sum(l * r) AS xy, sum(r * r) AS yy FROM sig2 GROUP BY 1),
g AS (SELECT f, CASE WHEN yy > 0 THEN CAST(greatest(least(floor(CAST(xy AS DOUBLE) / CAST(yy AS DOUBLE) * 4096 + 0.5), 32768), -32768) AS BIGINT) ELSE 0 END AS g FROM s)
SELECT n, g, l - CASE WHEN g * r >= 0 THEN (g * r + 2048) >> 12 ELSE (g * r - 2047) >> 12 END AS res FROM sig2 JOIN g ON n // 256 = f""", "sig2")
def fn_12_gain_q12(spark, d):
    s = stereo(spark, d).withColumn("f", div("n", 256))
    g = s.groupBy("f").agg(F.sum(F.col("l") * F.col("r")).alias("xy"), F.sum(F.col("r") * F.col("r")).alias("yy")).select("f", sc.fit_q12(F.col("xy"), F.col("yy")).alias("g"))
    return s.join(g, "f").select("n", "g", (F.col("l") - sc.apply_q12(F.col("g"), F.col("r"))).alias("res"))


@query("SELECT n, CASE WHEN x <= 0 THEN 0 ELSE CAST(least(greatest(floor(2 * log2(CAST(x AS DOUBLE))) + 1, 0), 39) AS BIGINT) END AS cls FROM sig")
def fn_14_classes(spark, d):
    return mono(spark, d).select("n", sc.half_octave(F.col("x")).alias("cls"))


@query("SELECT n, round(21.4 * log10(0.00437 * abs(x) + 1), 6) AS erb, round(greatest(power(0.5 + 0.5 * abs(x) / 1000.0, 0.23) - 1, 0), 6) AS loud FROM sig")
def fn_16_loudness(spark, d):
    a = F.abs(F.col("x")).cast("double")
    return mono(spark, d).select("n", F.round(sc.erb_rate(a), 6).alias("erb"), F.round(sc.loudness(a, F.lit(1000.0)), 6).alias("loud"))


@query("""WITH RECURSIVE s AS (SELECT CAST(0 AS BIGINT) AS k, CAST(19088743 AS BIGINT) AS x UNION ALL
SELECT k + 1, xor(b, (b << 5) & 4294967295) FROM (SELECT k, xor(a, a >> 17) AS b FROM (SELECT k, xor(x, (x << 13) & 4294967295) AS a FROM s WHERE k < 64)))
SELECT k, x FROM s WHERE k > 0""", "")
def fn_18_noise(spark, d):
    """64 words of the published 32-bit xorshift generator, folded in an array. Its shifts 13, 17 and 5."""
    low = lambda c: c.bitwiseAND(0xFFFFFFFF)

    def step(x):
        a = x.bitwiseXOR(low(F.shiftleft(x, 13)))
        b = a.bitwiseXOR(F.shiftright(a, 17))
        return b.bitwiseXOR(low(F.shiftleft(b, 5)))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.array(F.lit(0x1234567).cast("long")), lambda s, _: F.concat(s, F.array(step(F.element_at(s, -1)))))
    return spark.range(1).select(F.posexplode(fold).alias("k", "x")).filter("k > 0").select(F.col("k").cast("long").alias("k"), "x")


@query("SELECT n // 256 AS f, round(exp(avg(ln(abs(x) + 1.0))) / avg(abs(x) + 1.0), 6) AS flat FROM sig GROUP BY 1")
def fn_20_flatness(spark, d):
    a = F.abs(F.col("x")) + 1.0
    return mono(spark, d).groupBy(div("n", 256).alias("f")).agg(F.round(F.exp(F.avg(F.log(a))) / F.avg(a), 6).alias("flat"))


@query("""WITH c AS (SELECT n // 256 AS f, CAST(count(*) AS DOUBLE) AS c, CAST(count(*) FILTER (x > 10000) AS DOUBLE) AS o FROM sig GROUP BY 1)
SELECT f, round(CASE WHEN o = 0 OR o = c THEN 0 ELSE -c * (o / c * log2(o / c) + (1 - o / c) * log2(1 - o / c)) END, 6) AS bits FROM c""")
def fn_21_entropy(spark, d):
    c = mono(spark, d).groupBy(div("n", 256).alias("f")).agg(F.count("*").cast("double").alias("c"), F.count_if(F.col("x") > 10000).cast("double").alias("o"))
    return c.select("f", F.round(sc.binary_entropy(F.col("c"), F.col("o")), 6).alias("bits"))


@query("""WITH c AS (SELECT user_id, count(*) AS c FROM sigu GROUP BY 1), m AS (SELECT *, CAST(floor(c * 1000.0 / 44 + 0.5) AS BIGINT) AS ms FROM c)
SELECT user_id, CAST(floor(128 * 125.0 * c / 44) AS BIGINT) AS bytes, printf('%02d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS duration FROM m""", "sigu")
def fn_23_duration(spark, d):
    c = by_user(spark, d).groupBy("user_id").agg(F.count("*").alias("c"))
    return c.select("user_id", sc.cbr_bytes(F.lit(128), F.col("c"), 44).alias("bytes"), sc.duration(F.col("c"), 44).alias("duration"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%.png' THEN 'image/png' WHEN lower(p_name) LIKE '%.jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime,
'name=' || p_name || chr(10) || 'brand=' || p_brand AS meta, p_brand AS brand FROM part""", "")
def fn_25_metadata(spark, d):
    """Key=value lines put together and read again; the first of a key counts."""
    p = table(spark, d, "part").select("p_partkey", sc.mime(F.col("p_name")).alias("mime"), F.concat(F.lit("name="), "p_name", F.lit("\nbrand="), "p_brand").alias("meta"))
    line = F.element_at(F.filter(F.split("meta", "\n"), lambda x: x.startswith("brand=")), 1)
    return p.withColumn("brand", F.substring(line, 7, 1_000_000))


@query("SELECT DISTINCT CAST(p_size AS BIGINT) AS s, CAST(greatest(floor(p_size * 44100.0 / 1024), 1) AS BIGINT) AS frames FROM part", "")
def fn_30_entry_frames(spark, d):
    return table(spark, d, "part").select(F.col("p_size").cast("long").alias("s")).distinct().withColumn("frames", sc.frames_per_entry(F.col("s"), 44100))


@query("""SELECT CAST(i AS BIGINT) AS i, round(CASE WHEN i < 63.75 THEN 0.5 * (1 + cos(pi() * (i / 63.75 - 1))) WHEN i > 255 - 63.75 THEN 0.5 * (1 + cos(pi() * (i / 63.75 - 4.0 + 1))) ELSE 1 END, 6) AS w
FROM (SELECT unnest(range(256)) AS i)""", "")
def fn_29_tukey(spark, d):
    return spark.range(256).select(F.col("id").alias("i"), F.round(sc.tukey(F.col("id"), 256), 6).alias("w"))


@query("""SELECT CAST(k AS BIGINT) AS k, round(13 * atan(0.00076 * (k * 100)) + 3.5 * atan(power(k * 100 / 7500.0, 2)), 6) AS bark,
round(3.64 * power(greatest(k * 100, 20) / 1000.0, -0.8) - 6.5 * exp(-0.6 * power(greatest(k * 100, 20) / 1000.0 - 3.3, 2)) + 1e-3 * power(greatest(k * 100, 20) / 1000.0, 4), 5) AS quiet,
round(15.81 + 7.5 * (k / 10.0 + 0.474) - 17.5 * sqrt(1 + (k / 10.0 + 0.474) * (k / 10.0 + 0.474)), 6) AS spread FROM (SELECT unnest(range(1, 200)) AS k)""", "")
def psy_02_curves(spark, d):
    hz = F.col("id") * F.lit(100.0)
    return spark.range(1, 200).select(F.col("id").alias("k"), F.round(sc.bark(hz), 6).alias("bark"), F.round(sc.quiet_db(hz), 5).alias("quiet"), F.round(sc.spread_db(F.col("id") / F.lit(10.0)), 6).alias("spread"))


@query("""WITH e AS (SELECT n // 64 AS f, n % 8 AS b, CAST(sum(x * x) AS DOUBLE) + 1 AS e FROM sig GROUP BY ALL), s AS (SELECT i, j, power(10.0, (15.81 + 7.5 * (i - j + 0.474) - 17.5 * sqrt(1 + (i - j + 0.474) * (i - j + 0.474))) / 10) AS w
FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)), m AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM s)
SELECT f, CAST(i AS BIGINT) AS b, round(10 * log10(sum(e * w)), 6) AS thr_db FROM e JOIN m ON e.b = m.j GROUP BY ALL""")
def psy_08_spread_threshold(spark, d):
    """Energies of eight bands spread over each other by a normalised matrix of 64 cells, a constant broadcast by its size."""
    e = mono(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 8).alias("j")).agg((F.sum(F.col("x") * F.col("x")).cast("double") + 1).alias("e"))
    cells = spark.range(64).select(F.floor(F.col("id") / 8).alias("i"), (F.col("id") % 8).alias("j"))
    w = F.pow(F.lit(10.0), sc.spread_db((F.col("i") - F.col("j")).cast("double")) / 10)
    m = cells.withColumn("w", w).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i")))
    return e.join(F.broadcast(m), "j").groupBy("f", F.col("i").alias("b")).agg(F.round(10 * F.log10(F.sum(F.col("e") * F.col("w"))), 6).alias("thr_db"))


@query("""WITH e AS (SELECT n // 64 AS f, n % 8 AS b, CAST(sum(x * x) AS DOUBLE) AS e FROM sig GROUP BY ALL)
SELECT f, b, round(least(e, COALESCE(lag(e) OVER w, e), 4 * COALESCE(lead(e) OVER w, e)), 2) AS thr FROM e WINDOW w AS (PARTITION BY b ORDER BY f)""")
def psy_11_temporal(spark, d):
    """Each band's energy, no more than the frame before it and four times the frame after it."""
    e = mono(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 8).alias("b")).agg(F.sum(F.col("x") * F.col("x")).cast("double").alias("e"))
    w = Window.partitionBy("chunk", "b").orderBy("f")
    rows = halo(e, 1, 1, n="f").withColumn("thr", F.round(F.least("e", F.coalesce(F.lag("e").over(w), "e"), 4 * F.coalesce(F.lead("e").over(w), "e")), 2))
    return owned(rows, "f", "b", "thr")


@query("SELECT n, l, r, (l + r) >> 1 AS mid, l - r AS side, l AS l2, r AS r2 FROM sig2", "sig2")
def ll_01_joint_stereo(spark, d):
    s = stereo(spark, d).withColumns({"mid": F.shiftright(F.col("l") + F.col("r"), 1), "side": F.col("l") - F.col("r")})
    total = 2 * F.col("mid") + F.col("side").bitwiseAND(1)
    return s.withColumns({"l2": F.shiftright(total + F.col("side"), 1), "r2": F.shiftright(total - F.col("side"), 1)})


@query("""WITH c AS (SELECT n // 256 AS f, sum(log2(1 + abs(l)) + log2(1 + abs(r))) AS lr, sum(log2(1 + abs((l + r) >> 1)) + log2(1 + abs(l - r))) AS ms,
sum(log2(1 + abs(l)) + log2(1 + abs(l - r))) AS ls, sum(log2(1 + abs(r)) + log2(1 + abs(l - r))) AS rs FROM sig2 GROUP BY 1)
SELECT f, CASE WHEN lr <= ms AND lr <= ls AND lr <= rs THEN 'lr' WHEN ms <= ls AND ms <= rs THEN 'ms' WHEN ls <= rs THEN 'ls' ELSE 'rs' END AS mode, round(least(lr, ms, ls, rs), 4) AS bits FROM c""", "sig2")
def ll_02_stereo_mode(spark, d):
    bits = lambda *cs: F.sum(sum((F.log2(1 + F.abs(c)) for c in cs[1:]), F.log2(1 + F.abs(cs[0]))))
    left, right = F.col("l"), F.col("r")
    c = stereo(spark, d).groupBy(div("n", 256).alias("f")).agg(bits(left, right).alias("lr"), bits(F.shiftright(left + right, 1), left - right).alias("ms"), bits(left, left - right).alias("ls"), bits(right, left - right).alias("rs"))
    mode = F.when((F.col("lr") <= F.col("ms")) & (F.col("lr") <= F.col("ls")) & (F.col("lr") <= F.col("rs")), "lr").when((F.col("ms") <= F.col("ls")) & (F.col("ms") <= F.col("rs")), "ms").when(F.col("ls") <= F.col("rs"), "ls").otherwise("rs")
    return c.select("f", mode.alias("mode"), F.round(F.least("lr", "ms", "ls", "rs"), 4).alias("bits"))


_DIFFS = """WITH l AS (SELECT n, x AS a, COALESCE(lag(x) OVER (ORDER BY n), 0) AS b, COALESCE(lag(x, 2) OVER (ORDER BY n), 0) AS c, COALESCE(lag(x, 3) OVER (ORDER BY n), 0) AS e FROM sig),
r AS (SELECT n, a AS r0, a - b AS r1, a - 2 * b + c AS r2, a - 3 * b + 3 * c - e AS r3 FROM l)"""


@query(_DIFFS + """, c AS (SELECT n // 256 AS f, round(sum(log2(1 + abs(r0))), 4) AS c0, round(sum(log2(1 + abs(r1))), 4) AS c1, round(sum(log2(1 + abs(r2))), 4) AS c2, round(sum(log2(1 + abs(r3))), 4) AS c3 FROM r GROUP BY 1)
SELECT f, CAST(CASE WHEN c0 <= least(c1, c2, c3) THEN 0 WHEN c1 <= least(c2, c3) THEN 1 WHEN c2 <= c3 THEN 2 ELSE 3 END AS INTEGER) AS best, least(c0, c1, c2, c3) AS cost FROM c""")
def ll_03_best_fixed_order(spark, d):
    c = framing.differences(mono(spark, d)).groupBy(div("n", 256).alias("f")).agg(*(F.round(F.sum(F.log2(1 + F.abs(f"r{k}"))), 4).alias(f"c{k}") for k in range(4)))
    best = F.when(F.col("c0") <= F.least("c1", "c2", "c3"), 0).when(F.col("c1") <= F.least("c2", "c3"), 1).when(F.col("c2") <= F.col("c3"), 2).otherwise(3)
    return c.select("f", best.alias("best"), F.least("c0", "c1", "c2", "c3").alias("cost"))


@query("""SELECT a.n // 256 AS f, a.n - b.n AS lag, CAST(sum(a.x * b.x) AS BIGINT) AS r FROM sig a JOIN sig b ON a.n // 256 = b.n // 256 AND a.n - b.n BETWEEN 0 AND 12 GROUP BY ALL""")
def ll_04_autocorrelation(spark, d):
    """Lags 0 to 12 inside frames of 256: each sample is dealt to the places it is a partner of, one equi-join."""
    s = mono(spark, d)
    later = s.select(F.explode(F.sequence(F.col("n"), F.col("n") + 12)).alias("n"), F.col("n").alias("m"), F.col("x").alias("y"))
    pairs = s.join(later, "n").filter("floor(n / 256) = floor(m / 256)")
    return pairs.groupBy(div("n", 256).alias("f"), (F.col("n") - F.col("m")).alias("lag")).agg(F.sum(F.col("x") * F.col("y")).alias("r"))


@query("""WITH p AS (SELECT n, x, COALESCE(lag(x) OVER (ORDER BY n), 0) AS a, COALESCE(lag(x, 2) OVER (ORDER BY n), 0) AS b FROM sig) SELECT n, x - ((7000 * a - 3000 * b) >> 12) AS res FROM p""")
def ll_06_linear_residual(spark, d):
    w = near()
    lag = lambda k: F.coalesce(F.lag("x", k).over(w), F.lit(0))
    return owned(halo(mono(spark, d), 2, 0).withColumn("res", F.col("x") - F.shiftright(7000 * lag(1) - 3000 * lag(2), 12)), "n", "res")


@query("SELECT n // 512 AS b, min(x) AS lo, max(x) AS hi, count(*) FILTER (x BETWEEN 500 AND 12000) AS inside FROM sig GROUP BY 1")
def ll_18_bounds(spark, d):
    return mono(spark, d).groupBy(div("n", 512).alias("b")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("x").between(500, 12000)).alias("inside"))


@query("SELECT n, CAST(2 * floor(log2(x + 1)) + 1 AS BIGINT) AS l FROM sig WHERE x >= 0")
def en_05_golomb_length(spark, d):
    return mono(spark, d).filter("x >= 0").select("n", sc.golomb_length(F.col("x")).alias("l"))


@query(_DIFFS + """ SELECT n, r1 = 0 AS zero, r1 < 0 AS negative, CASE WHEN r1 = 0 THEN 0 ELSE CAST(floor(log2(abs(r1))) AS INTEGER) END AS exponent FROM r""")
def en_07_symbols(spark, d):
    r = framing.differences(mono(spark, d))
    return r.select("n", (F.col("r1") == 0).alias("zero"), (F.col("r1") < 0).alias("negative"), F.when(F.col("r1") == 0, 0).otherwise(sc.bit_length(F.abs("r1")) - 1).cast("int").alias("exponent"))


@query("SELECT n, x FROM sig")
def ll_12_round_trip(spark, d):
    """The whole signal coded in segments and decoded again: it must come back."""
    return lossless.decode(lossless.encode(mono(spark, d)))


@query("SELECT user_id, n, x FROM sigu", "sigu")
def ll_20_many_signals(spark, d):
    return lossless.decode(lossless.encode(by_user(spark, d), by=("user_id",)), by=("user_id",))


@query("SELECT n // 4096 AS seg, min(n) AS start, count(*) AS count, true AS smaller FROM sig GROUP BY 1")
def ll_17_segments(spark, d):
    """Coded segments: each is smaller than its samples as 16-bit integers, in which they fit."""
    return lossless.encode(mono(spark, d)).select("seg", "start", "count", (F.octet_length("payload") < 3 * F.col("count")).alias("smaller"))


@query("""WITH s AS (SELECT n // 4096 AS seg, min(n) AS start, count(*) AS c FROM sig GROUP BY 1)
SELECT seg, start - COALESCE(lag(start) OVER (ORDER BY seg), 0) AS d_start, start - COALESCE(lag(start + c) OVER (ORDER BY seg), 0) AS gap FROM s""")
def src_08_table_deltas(spark, d):
    """A block table's starts as distances from the block before it and from its end."""
    s = mono(spark, d).groupBy(div("n", 4096).alias("seg")).agg(F.min("n").alias("start"), F.count("*").alias("c"))
    w = near("seg")
    rows = halo(s, 1, 0, n="seg").withColumns({"d_start": F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(0)), "gap": F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("c")).over(w), F.lit(0))})
    return owned(rows, "seg", "d_start", "gap")


@query("SELECT l_linenumber % 3 AS n_sources, CASE l_linenumber % 3 WHEN 0 THEN 'AUDIO' WHEN 1 THEN 'REF' ELSE 'REF2' END AS type, count(*) AS blocks FROM lineitem GROUP BY ALL", "")
def src_13_block_types(spark, d):
    k = F.col("l_linenumber") % 3
    return table(spark, d, "lineitem").groupBy(k.alias("n_sources"), F.when(k == 0, "AUDIO").when(k == 1, "REF").otherwise("REF2").alias("type")).agg(F.count("*").alias("blocks"))


@query("SELECT p_partkey, 'brand=' || p_brand || chr(10) || 'size=' || (p_size + 1) || chr(10) || 'type=' || p_type AS meta FROM part", "")
def src_15_retag(spark, d):
    """Metadata maps with one key replaced and one added, as sorted lines."""
    p = table(spark, d, "part")
    old = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))
    new = F.create_map(F.lit("size"), (F.col("p_size") + 1).cast("string"), F.lit("type"), "p_type")
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    lines = F.transform(F.array_sort(F.map_entries(F.map_concat(kept, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return p.select("p_partkey", F.array_join(lines, "\n").alias("meta"))

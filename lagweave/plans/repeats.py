"""Queries of the wider searches for repeated material and of what is decided on its gains."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import similarity
from ..operators.signals import div, fingerprints, halo, mono, near, owned, stereo
from .registry import query
from .search import _REPEATS


def _align_sql(name: str, signal: str, guesses: str, size: int, reach: int) -> str:
    """CTEs ending in ``name`` (t, o, ncc): the best place within ``reach`` of a guess, by normalised correlation."""
    return f"""{name}_l AS (SELECT t, unnest(range(guess - {reach}, guess + {reach + 1})) AS o FROM {guesses}),
{name}_s AS (SELECT t, o, sum(a.x * b.x) AS xy, sum(a.x * a.x) AS xx, sum(b.x * b.x) AS yy FROM {name}_l JOIN {signal} a ON a.n // {size} = t JOIN {signal} b ON b.n = o + a.n % {size} WHERE o >= 0 AND o + {size} <= t * {size} GROUP BY ALL),
{name} AS (SELECT t, arg_max(o, (ncc, -o)) AS o, max(ncc) AS ncc FROM (SELECT t, o, round(CAST(xy AS DOUBLE) / sqrt(CAST(xx AS DOUBLE) * CAST(yy AS DOUBLE)), 6) AS ncc FROM {name}_s WHERE xx > 0 AND yy > 0) GROUP BY t)"""


_FAR = f"""WITH g AS (SELECT DISTINCT n // 128 AS t, ((n // 128 - 2) * 128 + 5) // 8 AS guess FROM sig WHERE n // 128 >= 3), low AS (SELECT n // 8 AS n, CAST(sum(x) AS BIGINT) AS x FROM sig GROUP BY 1),
{_align_sql("c", "low", "g", 16, 64)}, h AS (SELECT t, o * 8 AS guess FROM c), {_align_sql("far", "sig", "h", 128, 8)}"""


def _far(spark, d):
    s = mono(spark, d)
    guesses = s.select(div("n", 128).alias("t")).filter("t >= 3").distinct().withColumn("guess", F.expr("((t - 2) * 128 + 5) div 8"))
    return similarity.align_far(s, guesses, 128, 512, 8)


@query(_FAR + ' SELECT t, o AS "offset", ncc FROM far')
def jn_08_align_far(spark, d):
    """The alignment of each frame within 512 samples of its guess: all lags of the signal summed by eights, then eight samples either way."""
    return _far(spark, d).drop("guess")


@query(_FAR + f""", m AS (SELECT t + 1 AS t, o + 128 AS guess FROM far), {_align_sql("near", "sig", "m", 128, 4)} SELECT t, o AS "offset", o - guess AS drift, ncc FROM near JOIN m USING (t)""")
def jn_09_drift(spark, d):
    """How far a lineage that goes on from the frame before has drifted: alignment within four samples of where it would go on."""
    s = mono(spark, d)
    onward = _far(spark, d).select((F.col("t") + 1).alias("t"), (F.col("offset") + 128).alias("guess"))
    return similarity.align(s, onward, 128, 4).select("t", "offset", (F.col("offset") - F.col("guess")).alias("drift"), "ncc")


@query("""WITH e AS (SELECT n // 64 AS f, round(10 * log10(sum(x * x) + 1.0), 6) AS e FROM sig GROUP BY 1), p AS (SELECT a.f, a.f - b.f AS lag, (a.e - b.e) * (a.e - b.e) AS d FROM e a JOIN e b ON b.f + 2 <= a.f),
w AS (SELECT f, lag, round(sqrt(avg(d) OVER v), 6) AS d, count(*) OVER v AS c FROM p WINDOW v AS (PARTITION BY lag ORDER BY f ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)), g AS (SELECT CAST(unnest([2, 16, 64]) AS BIGINT) AS least)
SELECT f, least, arg_min(lag, (d, lag)) AS lag, min(d) AS d FROM w JOIN g ON lag >= least WHERE c >= 16 GROUP BY ALL""")
def jn_18_lag_map(spark, d):
    """For each frame the lag, of all, at which the last 32 frames' levels differ least; of all lags from 2, from 16 and from 64 frames on."""
    e = mono(spark, d).groupBy(div("n", 64).alias("f")).agg(F.round(10 * F.log10(F.sum(F.col("x") * F.col("x")) + 1.0), 6).alias("e"))
    return similarity.lag_map(e, (2, 16, 64))


_GAINS = """g AS (SELECT s.n // 64 AS f, CAST(sum(s.l * s.r) AS DOUBLE) / sum(s.r * s.r) AS g1, sum(s.r * s.r) AS rr FROM sig2 s GROUP BY 1 HAVING sum(s.r * s.r) > 0)"""


@query(f"""WITH {_GAINS}, p AS (SELECT a.n // 64 AS f, a.l, a.r, b.l AS p FROM sig2 a JOIN sig2 b ON b.n = a.n - 64)
SELECT f, round(max(g1), 6) AS g1, round(sum((l - g1 * r) * p) / sum(p * p), 6) AS g2 FROM p JOIN g USING (f) GROUP BY f HAVING sum(p * p) > 0""", "sig2")
def jn_25_sequential_gains(spark, d):
    """The gain of a first source by least squares, and that of a second one (the signal a frame before) on what the first leaves."""
    s = stereo(spark, d)
    before = s.select((F.col("n") + 64).alias("n"), F.col("l").alias("p"))
    sums = s.withColumn("f", div("n", 64)).groupBy("f").agg(F.sum(F.col("l") * F.col("r")).alias("lr"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    pairs = s.join(before, "n").withColumn("f", div("n", 64)).groupBy("f").agg(F.sum(F.col("l") * F.col("p")).alias("lp"), F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    g1 = F.col("lr").cast("double") / F.col("rr")
    return sums.join(pairs, "f").filter("rr > 0 AND pp > 0").select("f", F.round(g1, 6).alias("g1"), F.round((F.col("lp") - g1 * F.col("rp")) / F.col("pp"), 6).alias("g2"))


@query(_REPEATS + """, i AS (SELECT t, t - s AS lag, t - row_number() OVER (PARTITION BY t - s ORDER BY t) AS g FROM b), q AS (SELECT n // 64 AS f, n % 4 AS region, 10 * log10((sum(CAST(l * l AS DOUBLE)) + 1) / (sum(CAST((l - r) * (l - r) AS DOUBLE)) + 1)) AS gain FROM sig2 GROUP BY ALL)
SELECT min(t) OVER w AS f0, t AS f, region, round(avg(gain) OVER w, 6) AS gain FROM i JOIN q ON f = t WINDOW w AS (PARTITION BY lag, g, region)""", "sig sig2")
def pl_19_pattern_gains(spark, d):
    """The mean prediction gain of each region over the run of frames of one lag, for each of its frames: what is good on average plays as a whole."""
    best = similarity.frame_match(mono(spark, d), 64).withColumn("lag", F.col("t") - F.col("s"))
    runs = best.withColumn("run", F.col("t") - F.row_number().over(Window.partitionBy("lag").orderBy("t"))).select(F.col("t").alias("f"), "lag", "run")
    left, e = F.col("l").cast("double"), (F.col("l") - F.col("r")).cast("double")
    gains = stereo(spark, d).groupBy(div("n", 64).alias("f"), (F.col("n") % 4).alias("region")).agg((10 * F.log10((F.sum(left * left) + 1) / (F.sum(e * e) + 1))).alias("gain"))
    both = runs.join(gains, "f")
    means = both.groupBy("lag", "run", "region").agg(F.min("f").alias("f0"), F.avg("gain").alias("gain"))
    return both.drop("gain").join(means, ["lag", "run", "region"]).select("f0", "f", "region", F.round("gain", 6).alias("gain"))


@query("""WITH k AS (SELECT unnest(range(33)) AS k), s AS (SELECT n // 64 AS f, k, sum((l - r) * cos(2 * pi() * k * (n % 64) / 64)) AS re, sum((l - r) * sin(2 * pi() * k * (n % 64) / 64)) AS im FROM sig2 CROSS JOIN k GROUP BY ALL)
SELECT f, k, round(sqrt(re * re + im * im) / 64, 3) AS amplitude FROM s""", "sig2")
def qm_13_error_spectrum(spark, d):
    """Amplitudes of the difference of two signals in frames of 64: subtracted first, then transformed, so that what both share leaves nothing."""
    angle = F.lit(2 * math.pi) * F.col("k") * F.col("i") / 64
    e = stereo(spark, d).select(div("n", 64).alias("f"), (F.col("n") % 64).alias("i"), (F.col("l") - F.col("r")).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(32)).cast("array<bigint>")).alias("k"))
    s = e.groupBy("f", "k").agg(F.sum(F.col("e") * F.cos(angle)).alias("re"), F.sum(F.col("e") * F.sin(angle)).alias("im"))
    return s.select("f", "k", F.round(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 64, 3).alias("amplitude"))


#: What a level of effort from 1 to 9 tries. Nearest frames, nearest sections, pairs, nearest onsets, continuations, drift refinements, frames between decision and commit, whether bits are estimated as they are coded.
EFFORT = [
    (1, 2, 0, 0, 0, 4, 0, 2, False),
    (2, 4, 2, 0, 0, 4, 0, 2, False),
    (3, 6, 3, 0, 3, 12, 2, 2, False),
    (4, 8, 3, 1, 4, 12, 2, 2, False),
    (5, 12, 3, 1, 4, 24, 6, 2, False),
    (6, 16, 4, 1, 5, 24, 6, 2, False),
    (7, 24, 4, 3, 5, 48, 16, 16, True),
    (8, 32, 4, 3, 6, 48, 16, 16, True),
    (9, 48, 5, 3, 6, 64, 24, 16, True),
]
_EFFORT_NAMES = ("level", "k", "sections", "pairs", "onsets", "continuations", "drift", "lag", "coded")


@query(f"""WITH e AS (SELECT * FROM (VALUES {", ".join(str(r) for r in EFFORT)}) v({", ".join(_EFFORT_NAMES)})), m AS (SELECT f, f % 9 + 1 AS level FROM fp)
SELECT f, level, least(k, greatest(f - 2, 0)) AS nearest, CAST(sections AS BIGINT) AS sections, CAST(drift AS BIGINT) AS drift, coded FROM m JOIN e USING (level)""", "fp")
def pl_01_effort(spark, d):
    """How many nearest frames a level of effort asks for, of those that there are."""
    e = spark.createDataFrame(EFFORT, ", ".join(f"{n} {'boolean' if n == 'coded' else 'bigint'}" for n in _EFFORT_NAMES))
    f = fingerprints(spark, d).select("f", (F.col("f") % 9 + 1).alias("level"))
    return f.join(F.broadcast(e), "level").select("f", "level", F.least("k", F.greatest(F.col("f") - 2, F.lit(0))).alias("nearest"), "sections", "drift", "coded")


@query("""WITH h AS (SELECT n, CAST(x AS DOUBLE) AS hz FROM sig WHERE x > 0), t AS (SELECT n, hz, CASE WHEN hz <= 500 THEN 0.5 WHEN hz >= 8000 THEN 1.5 ELSE 0.5 + ln(hz / 500) / ln(16.0) END AS tilt FROM h)
SELECT n, round(tilt, 6) AS tilt, round(pow(10, greatest(least(6 * tilt, 6 + 2.0), 6 - 2.5, 1.0) / 10), 6) AS factor FROM t""")
def fn_27_tilt(spark, d):
    """The exponent of a threshold's offset at a frequency, linear in its logarithm between two corners, and the factor of an offset of 6 dB within its rails."""
    hz = F.col("x").cast("double")
    tilt = F.when(hz <= 500, 0.5).when(hz >= 8000, 1.5).otherwise(0.5 + F.ln(hz / 500) / math.log(16.0))
    rails = F.greatest(F.least(6 * F.col("t"), F.lit(8.0)), F.lit(3.5), F.lit(1.0))
    return mono(spark, d).filter("x > 0").withColumn("t", tilt).select("n", F.round("t", 6).alias("tilt"), F.round(F.pow(F.lit(10.0), rails / 10), 6).alias("factor"))


@query("""WITH s AS (SELECT n, x, sum(CAST(x AS DOUBLE) * x) OVER (ORDER BY n ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING) AS before, sum(CAST(x AS DOUBLE) * x) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING) AS own, count(*) OVER (ORDER BY n ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING) AS c FROM sig)
SELECT n, round(least(own / 64, 4 * before / c), 4) AS limit_ FROM s WHERE n % 64 = 0 AND c = 512""")
def psy_09_pre_attack(spark, d):
    """What a frame's threshold may be: no more than four times the mean energy of the 512 samples before it."""
    e = F.col("x").cast("double") * F.col("x")
    s = halo(mono(spark, d), 512, 63).withColumns({"before": F.sum(e).over(near().rowsBetween(-512, -1)), "own_e": F.sum(e).over(near().rowsBetween(0, 63)), "c": F.count("*").over(near().rowsBetween(-512, -1))})
    return owned(s, "n", "before", "own_e", "c").filter("n % 64 = 0 AND c = 512").select("n", F.round(F.least(F.col("own_e") / 64, 4 * F.col("before") / F.col("c")), 4).alias("limit_"))

"""The search for nearest earlier frames against plain loops."""

import random

import numpy as np
import pytest

from lagweave.functions.nearest import nearest
from lagweave.operators.similarity import lag_map, nearest_earlier
from lagweave.plans.catalogue import QUERIES


def plain(x, y, k, hi):
    out = []
    for i in range(len(x)):
        d = np.zeros(hi[i])
        with np.errstate(all="ignore"):
            for a in range(x.shape[1]):
                d += (x[i, a] - y[: hi[i], a]) ** 2
        out += [(i, int(j), float(d[j])) for j in np.lexsort((np.arange(len(d)), d))[:k]]
    return out


def cases():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 7))
    hole, endless = x.copy(), x.copy()
    hole[rng.random(400) < 0.05, 3], endless[rng.random(400) < 0.05, 3] = np.nan, np.inf
    return {
        "normal": x, "ties": rng.integers(0, 2, (400, 7)).astype(float), "far from zero": x * 1e-3 + 1e6, "too large": x * 1e160, "too small": x * 1e-200,
        "of all sizes": x * 10.0 ** rng.integers(-6, 7, (400, 1)), "NaN": hole, "infinite": endless, "one": np.full((400, 7), 1.5), "copies": np.tile(x[:40], (10, 1)),
    }


@pytest.mark.parametrize("name", cases())
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_exact(name, k):
    x, tried = cases()[name], [0]

    def exact(i, j):
        tried[0] += len(i)
        d = np.zeros(len(i))
        with np.errstate(all="ignore"):
            for a in range(x.shape[1]):
                d += (x[i, a] - x[j, a]) ** 2
        return i, j, d

    hi = np.maximum(np.arange(len(x)) - 2, 0)
    got = list(zip(*(c.tolist() for c in nearest(x, x, k, np.zeros(len(x), int), hi, exact)), strict=True))
    assert repr(got) == repr(plain(x, x, k, hi))
    if name in ("normal", "far from zero", "copies"):
        assert tried[0] < hi.sum() / 8


@pytest.mark.parametrize("step", [1, 10**12])
def test_blocks_of_any_ids(spark, step):
    """Blocks are of as many frames wherever their ids are; ids far apart were blocks without number."""
    x = np.random.default_rng(1).integers(0, 9, (300, 5)).astype(float)
    rows = spark.createDataFrame([(i * step, v.tolist()) for i, v in enumerate(x)], "f long, v array<double>")
    got = sorted((r["t"] // step, r["rk"], r["s"] // step, r["d"]) for r in nearest_earlier(rows, 3, gap=2 * step, fewest=16).collect())
    want, seen = [], {}
    for t, s, d in plain(x, x, 3, np.maximum(np.arange(300) - 2, 0)):
        seen[t] = seen.get(t, 0) + 1
        want.append((t, seen[t], s, d))
    assert got == want


def test_no_frames(spark):
    assert nearest_earlier(spark.createDataFrame([], "f long, v array<double>"), 3).count() == 0


@pytest.mark.parametrize("name", ["jn_10_continuation", "jn_13_dedup"])
def test_the_search_runs_once(spark, name):
    """A union or a join of the search with itself ran it twice."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_lags_in_blocks_of_any_size(spark):
    """Levels with places that no frame has and runs that repeat, against loops over all lags."""
    rng = random.Random(5)
    e = {f: round(rng.gauss(80, 1.5), 6) for f in range(400) if f % 97 and not 250 <= f < 256} | {10**10 + f: 80.0 for f in range(40)}
    e |= {f: e[f - 60] for f in range(320, 380) if f in e and f - 60 in e}
    want = []
    for f in sorted(e):
        ways = []
        for s in sorted(e):
            d = [(e[f - k] - e[s - k]) ** 2 for k in range(32) if f - k in e and s - k in e]
            if s + 2 <= f and len(d) >= 16:
                total = 0.0
                for x in d:
                    total += x
                ways.append((float(np.round(np.sqrt(total / len(d)), 6)), f - s))
        for least in (2, 16, 64):
            if any(lag >= least for _, lag in ways):
                d, lag = min(w for w in ways if w[1] >= least)
                want.append((f, least, lag, d))
    levels = spark.createDataFrame(list(e.items()), "f long, e double")
    for fewest in (64, 2048):
        assert sorted((r["f"], r["least"], r["lag"], r["d"]) for r in lag_map(levels, (2, 16, 64), fewest=fewest).collect()) == sorted(want)

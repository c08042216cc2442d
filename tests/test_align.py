"""Alignment of frames by chunks against plain loops."""

import random

import pytest

from lagweave.operators import similarity
from lagweave.plans.catalogue import QUERIES


def plain(samples, guesses, size, reach):
    at = {}
    for n, x in samples:
        at.setdefault(n, []).append(x)
    for t, guess in guesses:
        ways = []
        for o in range(max(guess - reach, 0), min(guess + reach, t * size - size) + 1):
            pairs = [(a, b) for i in range(size) for a in at.get(t * size + i, []) for b in at.get(o + i, [])]
            xy, xx, yy = (sum(p) for p in zip(*((a * b, a * a, b * b) for a, b in pairs), strict=True)) if pairs else (0, 0, 0)
            if xx > 0 and yy > 0:
                ways.append((round(xy / (float(xx) * yy) ** 0.5, 6), -o))
        if ways:
            yield t, -max(ways)[1], max(ways)[0], guess


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_frames_with_gaps_zeros_and_repeated_numbers(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    rng = random.Random(2)
    samples = [(n, rng.randint(-50, 50)) for n in range(600) if n % 37 and not 200 <= n < 230] + [(n, 7) for n in range(90, 100)]
    samples += [(n, 0) for n in range(600, 640)] + [(10**10 + n, rng.randint(-50, 50)) for n in range(100)]
    guesses = [(t, max(8 * t - rng.randrange(8, 60), -3)) for t in range(2, 82)] + [((10**10 + 64) // 8, 10**10 + 9), ((10**10 + 72) // 8, 11)]
    got = similarity.align(spark.createDataFrame(samples, "n long, x long"), spark.createDataFrame(guesses, "t long, guess long"), 8, 5)
    rows = sorted(tuple(r) for r in got.select("t", "offset", "ncc", "guess").collect())
    assert rows == sorted(plain(samples, guesses, 8, 5))


def test_samples_are_not_joined_lag_by_lag(spark):
    """Samples met each other once a lag in joins, and drift ran the search before it twice."""
    for name, searches in (("jn_08_align", 1), ("jn_08_align_far", 2), ("jn_09_drift", 3)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == searches

"""Depths of whole chains of references against plain loops."""

import random

from lagweave.operators.similarity import depths
from lagweave.plans.details import candidates, pl_13_depth
from lagweave.sources.shared import ready

DATA = "/root/testdata/sf0.001"


def plain(links):
    out = {}
    for t in sorted(links):
        out[t] = 1 + out.get(links[t], 0)
    return out


def test_chains_of_any_frames(spark):
    ready(spark)
    rng = random.Random(3)
    links = {t: t - 1 for t in range(1, 70)} | {t: rng.randrange(t) for t in range(100, 300)}
    got = depths(spark.createDataFrame(list(links.items()), "t long, s long"))
    assert {r["t"]: r["depth"] for r in got.collect()} == plain(links)
    assert depths(spark.createDataFrame([], "t long, s long")).count() == 0


def test_every_frame_with_a_source_has_its_depth(spark):
    links = {r["t"]: r["s"] for r in candidates(spark, DATA, 1).collect()}
    rows = pl_13_depth(spark, DATA).collect()
    assert len(rows) == len(links) and {t % 3 for t in links} == {0, 1, 2}
    assert {r["t"]: r["depth"] for r in rows} == plain(links)

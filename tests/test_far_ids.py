"""Queries of the nearest-frame search against SQL where ids are far apart: their blocks were without number."""

import duckdb
import pytest

from lagweave.plans.catalogue import ORACLE_SQL, QUERIES

NAMES = [
    "pl_21_importance",
    "jn_12_pairs",
    "jn_10_continuation",
    "jn_17_weighted_distance",
    "pl_03_continuations",
    "jn_16_segment_deps",
    "pl_13_depth",
    "prj_09_same_segment",
    "pl_20_runs",
    "prj_08_final_sources",
    "pl_02_top_k",
    "jn_11_star_redirect",
    "jn_03_backward_knn",
    "ag_05_depth_histogram",
    "jn_04_onset_pool",
]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    path = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT vec_id * 1000000000000 AS vec_id, embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 120) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_ids_far_apart(spark, far, name):
    got = QUERIES[name](spark, str(far)).toArrow()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{far}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL[name])
    quoted = [f'"{c}"' for c in sorted(want.columns)]
    rows = con.from_arrow(got).select(*quoted).fetchall()
    assert sorted(map(repr, rows)) == sorted(map(repr, want.select(*quoted).fetchall()))

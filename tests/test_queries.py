"""Every registered query of the signal operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lagweave.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    if name not in ORACLE_SQL:
        assert got.num_columns > 0
        return
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.column_names) == columns
    quoted = [f'"{c}"' for c in columns]
    mine = duck.from_arrow(got)
    assert sorted(map(repr, mine.select(*quoted).fetchall())) == sorted(map(repr, want.select(*quoted).fetchall()))

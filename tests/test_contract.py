"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from quillgrid.plans import contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(contract.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = contract.QUERIES[name](spark, SF)
    want = con.sql(contract.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*want.columns).collect())))
    assert got == sorted(map(repr, want.fetchall()))

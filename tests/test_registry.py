"""Every registered query against its DuckDB oracle at sf0.001 (the driver runs sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from logsmith import registry
from tools.compare import digest, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["app_name", "log_count", "error_count"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    oracle = registry.ORACLE.get(name)
    assert oracle is not None, f"{name} has no oracle"
    cur = duck.execute(oracle)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]

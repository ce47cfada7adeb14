"""Every registered query against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from sitecontacts.plans import oracle
from sitecontacts.plans import queries as registered

DATA = "/root/testdata/sf0.001"
ORACLES = oracle.oracle_sql()
QUERIES = registered.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(str(tuple(row[i] for i in at)) for row in result.fetchall())
    assert got == want


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns[0] == "site_key"

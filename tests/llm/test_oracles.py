"""Registered queries of the subpackage against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sitecontacts.llm.oracle import ORACLES
from sitecontacts.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    want = sorted(con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    assert got == want

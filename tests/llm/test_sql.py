"""The numbered queries that SQL can express, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from tessel.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    want = con.sql(oracle.SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(str(tuple(r[c] for c in columns)) for r in found)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, r)) for r in want.fetchall())

"""Every query of the curation layer against DuckDB, at the smallest scale; the others by invariants."""

import math
import os

import duckdb
import pytest

from tessel import plans

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and not hasattr(v, "__len__"):
        return f"{float(v):.6g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_others_run_twice_alike(spark, name):
    one, two = (QUERIES[name](spark, DATA).toPandas() for _ in range(2))
    assert len(one) and sorted(map(str, one.to_dict("records"))) == sorted(map(str, two.to_dict("records")))

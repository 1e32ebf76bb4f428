"""Registered queries of the subpackage against their SQL counterparts."""

import os

import duckdb
import pytest

from headwater.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_query(spark, duck, sf, name):
    df, result = queries.queries()[name](spark, sf), duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(result.columns)
    pick = [result.columns.index(c) for c in cols]
    wanted = sorted((tuple(r[i] for i in pick) for r in result.fetchall()), key=repr)
    assert wanted and sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == wanted

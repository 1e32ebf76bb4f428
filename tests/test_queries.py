"""Every registered query against its SQL counterpart on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
from headwater.plans import oracles, queries

QUERIES = queries.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


def test_entry(spark):
    assert registered.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    result = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    cols = sorted(df.columns)
    pick = [result.columns.index(c) for c in cols]
    wanted = sorted((tuple(r[i] for i in pick) for r in result.fetchall()), key=repr)
    assert wanted, "the query must return rows"
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == wanted

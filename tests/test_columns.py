"""Column helpers."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headwater.functions import expressions as E
from headwater.functions import names as N


def col(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_table_key(spark):
    got = col(spark, ["Customers", "dbo.Customers", " [Db].[dbo].[My Table] ", '"D"."o"."C"', "[My.Table]", None], N.table_key)
    assert got == ["CUSTOMERS", "CUSTOMERS", "MY TABLE", "C", "TABLE", None]


def test_schema_kept(spark):
    assert col(spark, ["[Db].[dbo].[T]", "t"], N.table_key_with_schema) == ["DBO.T", "T"]


def test_parts(spark):
    got = col(spark, ["[a.b].[c]", '"x y".z', "`q`.r.s.t", "plain"], N.name_parts)
    assert got == [["a.b", "c"], ["x y", "z"], ["q", "r", "s", "t"], ["plain"]]
    assert col(spark, ["[a]", '"a"', "`a`", "[a", "a]b"], N.unquote) == ["a", "a", "a", "[a", "a]b"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab.\" \t", max_size=12), min_size=20, max_size=20))
def test_table_key_is_idempotent(spark, values):
    once = col(spark, values, N.table_key)
    assert col(spark, once, N.table_key) == once


def test_classify(spark):
    cases = {
        "s.a": "direct_copy", "[My Col]": "direct_copy", "a.[b c]": "direct_copy", "*": "direct_copy", "s.*": "direct_copy",
        "'x'": "constant", "N'x'": "constant", "12.5": "constant", "-3": "constant", "NULL": "constant", "getdate()": "constant",
        "CASE WHEN a = 1 THEN 'SUM(' END": "conditional", "SUM (x)": "aggregation", "STRING_AGG(x, ',')": "aggregation",
        "CHECKSUM(a)": "calculation", "a - b": "calculation", "dbo.f(a)": "calculation", "[CASE] + [WHEN]": "calculation",
        "f('a/b')": "calculation",
    }
    assert dict(zip(cases, col(spark, list(cases), E.classify))) == cases


def test_clock_and_snippet(spark):
    stamp = spark.range(1).select(E.utc_iso(F.timestamp_seconds(F.lit(0))).alias("t"), E.snippet(F.repeat(F.lit("x"), 400)).alias("s")).first()
    assert stamp.t == "1970-01-01T00:00:00Z" and len(stamp.s) == 300

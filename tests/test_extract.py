"""Small scripts with known lineage, extracted in one run."""

import pytest
from conftest import make_scripts

from headwater.operators import records as R

CASES = {
    "simple": """CREATE PROCEDURE [Shop].[dbo].[load_totals] AS BEGIN
        INSERT INTO [Shop].[dbo].[TOTALS] (id, name, n, revenue, last_day)
        SELECT c.id, c.name, COUNT(o.id) AS n, SUM(o.amount) AS revenue, MAX(o.day) AS last_day
        FROM [Shop].[dbo].[CUSTOMERS] c LEFT JOIN [Shop].[dbo].[ORDERS] o ON c.id = o.cust_id
        GROUP BY c.id, c.name; END""",
    "blanks": "INSERT INTO [dbo].[Target] ([First Day]) SELECT v.[Sent On] AS [First Day] FROM dbo.A v",
    "deletes": """DELETE FROM [dbo].[T] WHERE id = 1; DELETE FROM [dbo].[T] WHERE id = 2;
        INSERT INTO [dbo].[T] (a, b) SELECT s.a, s.b FROM [dbo].[S] s;""",
    "comments": """/* outer /* inner */ INSERT INTO no SELECT x FROM no */ INSERT INTO t -- FROM fake
        SELECT s.a, 'it''s -- here /* too */' AS note FROM src s WHERE s.b = '--'""",
    "declare": """DECLARE @n INT = (SELECT COUNT(*) FROM audit_log); SET @n = 3
        INSERT INTO t SELECT s.a FROM src s""",
    "exec": "INSERT INTO t SELECT s.use_date FROM src s; EXEC dbo.finish 1",
    "select_into": "SELECT a.x,\n  a.y\nINTO dbo.NewT\nFROM dbo.S a\nWHERE a.x > 1",
    "one_line": "SELECT 1; INSERT INTO t SELECT s.a FROM src s",
    "update": "UPDATE t SET t.v = s.v, t.w += s.w FROM dbo.Tgt t JOIN dbo.Src s ON t.id = s.id WHERE s.ok = 1",
    "merge_query": """MERGE INTO dbo.T AS t USING (SELECT q.id, q.v FROM dbo.S q WHERE q.ok = 1) AS s ON t.id = s.id
        WHEN MATCHED AND s.v > 1 THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v + 1);""",
    "two_inserts": "INSERT INTO a SELECT s.x FROM s1 s; INSERT INTO b SELECT s.x, s.y FROM s2 s;",
    "cte_chain": """WITH a AS (SELECT t.x FROM t1 t), b (x) AS (SELECT a.x FROM a)
        INSERT INTO z SELECT b.x FROM b""",
    "four_parts": "INSERT INTO [srv].[db].[dbo].[T4] SELECT s.a FROM db..S3 s",
    "temp": "INSERT INTO #tmp SELECT s.a FROM src s",
    "temp_source": "INSERT INTO t SELECT s.a, u.b FROM #stage s JOIN real_one u ON u.id = s.id",
    "no_alias": "INSERT INTO t SELECT a.x, x.y FROM a JOIN b x ON a.id = x.id WHERE a.k = 1",
    "commas": "INSERT INTO t SELECT a.x, b.y FROM t1 a, t2 AS b WHERE a.id = b.id",
    "function_from": "INSERT INTO t SELECT EXTRACT(YEAR FROM s.day) AS y, TRIM(' ' FROM s.name) AS n FROM src s",
    "classes": """INSERT INTO t SELECT CHECKSUM(s.a) AS c1, NULL AS c2, -1 AS c3, 'a' + 'b' AS c4, DISCOUNT(s.b) AS c5,
        s.e, GETDATE() AS c7, COUNT(*) AS c8, CASE WHEN s.a > 1 THEN 'SUM(' ELSE 'x' END AS c9, UPPER(s.f) AS c10 FROM src s""",
    "star": "INSERT INTO t SELECT * FROM src",
    "joins": """INSERT INTO t SELECT a.x FROM a JOIN b ON a.id = b.id CROSS JOIN c
        FULL OUTER JOIN (SELECT z.id FROM dd z JOIN ee y ON z.id = y.id) q ON q.id = a.id AND q.n IN (1, 2)""",
    "expression": "INSERT INTO t SELECT SUM(o.amount - d.disc) AS net, 1 + 2 AS three FROM orders o JOIN discounts d ON d.id = o.id",
    "items": """INSERT INTO t SELECT DISTINCT TOP (5) s.x, b = s.y, s.z total, (SELECT MAX(q.v) FROM qq q WHERE q.id = s.id) AS mx,
        s.[a,b] FROM src s""",
    "having": """INSERT INTO t SELECT s.g, COUNT(*) AS n FROM src s WHERE s.id IN (SELECT w.id FROM ww w WHERE w.k = 1 AND w.l = 2)
        AND s.brand = 1 OR (s.a = 1 AND s.b = 2) GROUP BY s.g HAVING COUNT(*) > 1 AND MIN(s.x) BETWEEN 1 AND 9 ORDER BY s.g""",
    "prefixes": "INSERT INTO t SELECT s.EndDate FROM src s WHERE s.EndDate > 1 AND s.LeftQty = 2 UNION SELECT u.a FROM more u WHERE u.z = 3",
    "no_into": "SELECT 1; INSERT dbo.Tgt (k, v) SELECT s.a, s.b FROM src s",
    "top_into": "INSERT TOP (5) INTO tgt SELECT s.a FROM src s",
    "trigger": "CREATE TRIGGER tr ON dbo.t AFTER INSERT, UPDATE AS BEGIN INSERT log_rows SELECT i.a FROM changes i END",
    "union": """INSERT INTO t (p, q) SELECT s.a, s.b AS bb FROM src s UNION ALL SELECT m.c, 1 FROM more m
        UNION SELECT m.c + x.y, x.b FROM more m JOIN extra x ON x.id = m.id""",
    "case_where": "INSERT INTO t SELECT s.a FROM src s WHERE CASE WHEN s.a = 1 AND s.b = 2 THEN 1 ELSE 0 END = 1 AND s.c = 3",
    "if_else": "IF EXISTS (SELECT 1 FROM ctl c) BEGIN INSERT INTO t SELECT s.a, s.bb FROM src s END ELSE BEGIN DELETE FROM t END",
    "go": "SELECT 1\nGO\nCREATE PROCEDURE p AS\nINSERT INTO t SELECT s.a FROM src s\nGO\nGRANT EXECUTE ON p TO u",
    "empty_proc": "CREATE PROCEDURE p AS BEGIN RETURN 1 END",
    "no_source": "INSERT INTO t SELECT 1 AS one",
    "long": "INSERT INTO t SELECT s.a, '" + "x''" * 200_000 + "' AS big FROM src s",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = R.extract_lineage(make_scripts(spark, CASES)).collect()
    return {r.source_file: r.asDict(True) for r in rows}


def maps(r):
    return [(m["target_column"], m["source_table"], m["source_column"], m["transformation_type"]) for m in r["column_mappings"]]


def test_simple(found):
    r = found["simple"]
    assert r["procedure_name"] == "LOAD_TOTALS" and r["target_table"] == "TOTALS"
    assert r["source_tables"] == ["CUSTOMERS", "ORDERS"] and len(r["column_mappings"]) == 5
    assert [j["join_type"] for j in r["joins"]] == ["LEFT"] and r["grouping"] == ["CUSTOMERS.id", "CUSTOMERS.name"]
    assert r["joins"][0]["condition"] == "CUSTOMERS.id = ORDERS.cust_id"
    assert [m["insert_column"] for m in r["column_mappings"]] == ["ID", "NAME", "N", "REVENUE", "LAST_DAY"]
    assert r["failure"] is None


def test_bracketed_names(found):
    assert maps(found["blanks"]) == [("FIRST DAY", "A", "SENT ON", "direct_copy")]


def test_primary_statement(found):
    assert found["deletes"]["source_tables"] == ["S"]
    assert found["two_inserts"]["target_table"] == "B"


def test_every_statement(spark):
    rows = R.extract_lineage(make_scripts(spark, {"two": CASES["two_inserts"]}), primary_only=False).collect()
    assert sorted((r.target_table, tuple(r.source_tables)) for r in rows) == [("A", ("S1",)), ("B", ("S2",))]


def test_comments_and_literals(found):
    r = found["comments"]
    assert r["source_tables"] == ["SRC"] and r["filters"] == ["SRC.b = '--'"]
    assert maps(r)[1][:3] == ("NOTE", "", "'it''s -- here /* too */'")


def test_session_noise(found):
    assert found["declare"]["source_tables"] == ["SRC"] and maps(found["declare"])[0][0] == "A"
    assert maps(found["exec"]) == [("USE_DATE", "SRC", "USE_DATE", "direct_copy")]
    assert found["if_else"]["source_tables"] == ["SRC"] and len(maps(found["if_else"])) == 2
    assert found["go"]["target_table"] == "T" and found["go"]["procedure_name"] == "P"


def test_select_into(found):
    assert found["select_into"]["target_table"] == "NEWT" and maps(found["select_into"])[1][0] == "Y"
    assert found["one_line"]["target_table"] == "T" and found["one_line"]["source_tables"] == ["SRC"]


def test_update_and_merge(found):
    r = found["update"]
    assert r["target_table"] == "TGT" and r["source_tables"] == ["SRC"]
    assert [m[:3] for m in maps(r)] == [("V", "SRC", "V"), ("W", "SRC", "W")]
    r = found["merge_query"]
    assert r["target_table"] == "T" and r["source_tables"] == ["S"] and r["joins"] == []
    assert [m[:3] for m in maps(r)] == [("V", "S", "V"), ("ID", "S", "ID")]


def test_cte_chain(found):
    r = found["cte_chain"]
    assert r["source_tables"] == ["T1"] and maps(r) == [("X", "T1", "X", "direct_copy")]


def test_name_parts_and_temp_tables(found):
    assert found["four_parts"]["target_table"] == "T4" and found["four_parts"]["source_tables"] == ["S3"]
    assert found["temp"]["failure"] == "temp_target"
    assert found["temp_source"]["source_tables"] == ["REAL_ONE"]


def test_aliases(found, spark):
    assert [m[:3] for m in maps(found["no_alias"])] == [("X", "A", "X"), ("Y", "B", "Y")]
    assert found["commas"]["source_tables"] == ["T1", "T2"]
    assert [m[:3] for m in maps(found["commas"])] == [("X", "T1", "X"), ("Y", "T2", "Y")]
    rows = R.aliases(make_scripts(spark, {"x": CASES["no_alias"]})).collect()
    assert {(r.alias, r.table_name) for r in rows} == {("a", "A"), ("b", "B"), ("x", "B")}


def test_function_from(found):
    r = found["function_from"]
    assert r["source_tables"] == ["SRC"]
    assert [m[:3] for m in maps(r)] == [("Y", "SRC", "DAY"), ("N", "SRC", "NAME")]


def test_classes(found):
    types = {m[0]: m[3] for m in maps(found["classes"])}
    assert types == {"C1": "calculation", "C2": "constant", "C3": "constant", "C4": "calculation", "C5": "calculation",
                     "E": "direct_copy", "C7": "constant", "C8": "aggregation", "C9": "conditional", "C10": "calculation"}
    assert maps(found["star"]) == [("*", "SRC", "*", "direct_copy")]


def test_joins(found):
    got = [(j["left_table"], j["right_table"], j["join_type"], j["condition"]) for j in found["joins"]["joins"]]
    assert got == [
        ("A", "B", "INNER", "A.id = B.id"), ("A", "C", "CROSS", ""), ("A", "DD", "FULL", "q.id = A.id AND q.n IN (1, 2)"),
        ("A", "EE", "INNER", "DD.id = EE.id")]
    assert found["joins"]["source_tables"] == ["A", "B", "C", "DD", "EE"]


def test_expression_sources(found):
    assert maps(found["expression"]) == [
        ("NET", "ORDERS", "AMOUNT", "aggregation"), ("NET", "DISCOUNTS", "DISC", "aggregation"), ("THREE", "", "1 + 2", "calculation")]


def test_select_items(found):
    r = found["items"]
    assert [m[0] for m in maps(r) if m[1] == "SRC"][:3] == ["X", "B", "TOTAL"]
    assert ("MX", "QQ", "V", "aggregation") in maps(r) and maps(r)[-1][:3] == ("A,B", "SRC", "A,B")
    assert r["source_tables"] == ["QQ", "SRC"]


def test_filters(found, spark):
    assert found["having"]["filters"] == [
        "SRC.id IN (SELECT WW.id FROM ww w WHERE WW.k = 1 AND WW.l = 2)", "SRC.brand = 1", "(SRC.a = 1 AND SRC.b = 2)",
        "COUNT(*) > 1", "MIN(SRC.x) BETWEEN 1 AND 9"]
    assert found["having"]["grouping"] == ["SRC.g"]
    assert found["prefixes"]["filters"] == ["SRC.EndDate > 1", "SRC.LeftQty = 2", "MORE.z = 3"]
    assert found["case_where"]["filters"] == ["CASE WHEN SRC.a = 1 AND SRC.b = 2 THEN 1 ELSE 0 END = 1", "SRC.c = 3"]
    rows = R.filters(make_scripts(spark, {"x": CASES["having"]})).orderBy("seq").collect()
    assert [(r.clause, r.connective) for r in rows] == [
        ("WHERE", None), ("WHERE", "AND"), ("WHERE", "OR"), ("HAVING", None), ("HAVING", "AND")]


def test_insert_without_into(found):
    r = found["no_into"]
    assert r["target_table"] == "TGT" and r["source_tables"] == ["SRC"] and r["failure"] is None
    assert [(m["target_column"], m["insert_column"]) for m in r["column_mappings"]] == [("A", "K"), ("B", "V")]
    assert found["top_into"]["target_table"] == "TGT" and maps(found["top_into"]) == [("A", "SRC", "A", "direct_copy")]
    assert found["trigger"]["target_table"] == "LOG_ROWS" and found["trigger"]["source_tables"] == ["CHANGES"]


def test_every_branch_of_a_set_operation(found):
    r = found["union"]
    assert r["source_tables"] == ["EXTRA", "MORE", "SRC"]
    assert maps(r) == [("A", "SRC", "A", "direct_copy"), ("BB", "SRC", "B", "direct_copy"), ("A", "MORE", "C", "direct_copy"),
                       ("BB", "", "1", "constant"), ("A", "EXTRA", "Y", "calculation"), ("BB", "EXTRA", "B", "direct_copy")]
    assert [m["insert_column"] for m in r["column_mappings"]] == ["P", "Q", "P", "Q", "P", "Q"]


def test_failures(found):
    assert found["empty_proc"]["failure"] == "no_primary"
    assert found["no_source"]["failure"] == "no_source"


def test_whole_texts(found):
    note = maps(found["long"])[1]
    assert note[3] == "constant" and len(note[2]) == 600_002


def test_partitions_do_not_matter(spark):
    few = {k: v for k, v in CASES.items() if k != "long"}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, R.extract_lineage(make_scripts(spark, few)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_texts_are_read_and_shuffled_once(spark, tmp_path):
    from headwater.sources import files

    for i in range(3):
        (tmp_path / f"s{i}.sql").write_text(f"INSERT INTO t{i} SELECT s.a FROM src{i} s")
    df = R.extract_lineage(files.read_scripts(spark, str(tmp_path)))
    assert len(df.collect()) == 3
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan") == 1 and "Broadcast" not in plan


def test_large_expressions_are_made_once(spark):
    """A stream plans the extraction for each batch: expressions over columns by name are not built anew."""
    from headwater.operators import facts as X

    for make in (X._clause_start, X._defines, X._definition, X._piece, R._solved, R._mapped, R._class):
        assert make() is make()

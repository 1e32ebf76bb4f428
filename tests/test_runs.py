"""Routing, answers, files, incremental runs, streaming."""

import json
import os
import tempfile

import pytest
from conftest import make_scripts
from pyspark.sql import functions as F

from headwater.functions import shared
from headwater.operators import incremental as I
from headwater.operators import responses as A
from headwater.operators import routing as M
from headwater.plans import build
from headwater.sources import corpus, files
from headwater.sources.schemas import CATALOGUE, LINEAGE, OVERRIDES, TRACKER
from headwater.streaming import ingest

GOOD = "INSERT INTO t SELECT s.a FROM src s"


@pytest.fixture
def tmp():
    return tempfile.mkdtemp(prefix="headwater-test-")


def overrides(spark, *rows):
    return spark.createDataFrame(list(rows), OVERRIDES)


def test_signals_and_score(spark):
    wide = "SELECT " + ", ".join(f"f(a{i}, 'x,y')" for i in range(16)) + " FROM t"
    texts = {
        "simple": GOOD, "cursor": "DECLARE cur CURSOR FOR SELECT 1", "dynamic": "EXEC (@sql)", "wide": wide,
        "heavy": "\n" * 81 + "UPDATE a; DELETE FROM b; " + "LEFT OUTER JOIN x " * 5 + "CASE " * 7 + "(SELECT 1) UNPIVOT MERGE BEGIN TRY "
                 + "WITH c AS ( " + "[a b] " * 11,
    }
    rows = {r.source_file: r for r in M.recommend(M.score(M.signals(make_scripts(spark, texts))), "gemini").collect()}
    assert {k: r.score for k, r in rows.items()} == {"simple": 0, "cursor": 3, "dynamic": 3, "wide": 1, "heavy": 11}
    assert {k: r.recommended for k, r in rows.items()} == {
        "simple": "regex", "cursor": "gemini", "dynamic": "gemini", "wide": "regex", "heavy": "gemini"}
    assert rows["heavy"].line_count == 82 and rows["wide"].max_select_column_count == 16
    assert rows["wide"].reasons == ["wide SELECT list (16 columns)"]
    with pytest.raises(ValueError):
        M.recommend(M.score(M.signals(make_scripts(spark, texts))), "other")


def test_overrides_and_attempts(spark, tmp):
    path = f"{tmp}/o.json"
    with open(path, "w") as f:
        json.dump({"A.sql": "Gemini", "b.sql": "none"}, f)
    rows = files.read_overrides(spark, path).unionByName(overrides(spark, ("a.SQL", "nvidia", 1)))
    assert [(r.file_key, r.method) for r in M.merge_overrides(rows).collect()] == [("a.sql", "nvidia")]
    assert files.read_overrides(spark, f"{tmp}/missing.json").count() == 0
    with open(path, "w") as f:
        f.write("[1, 2]")
    assert files.read_overrides(spark, path).count() == 0
    routed = spark.createDataFrame([("p1", "a", "regex", False), ("p2", "b", "claude", False), ("p3", "c", "gemini", True),
                                    ("p4", "d", "nvidia", True), ("p5", "e", "nvidia", False)],
                                   "path STRING, source_file STRING, method STRING, is_override BOOLEAN")
    order = {}
    for r in M.attempts(routed, ["regex", "claude", "gemini"]).orderBy("path", "rank").collect():
        order.setdefault(r.path, []).append(r.method)
    assert order == {"p1": ["regex", "claude", "gemini"], "p2": ["claude", "gemini"], "p3": ["gemini", "regex", "claude"],
                     "p4": ["nvidia", "regex", "claude", "gemini"], "p5": ["regex", "claude", "gemini"]}


def test_user_stage(spark):
    def length(txt):
        if "boom" in txt:
            raise RuntimeError("no")
        return None if "none" in txt else {"target_table": txt[:3]}

    rows = M.user_stage(make_scripts(spark, {"a": "abcdef", "b": "boom", "c": "none"}), length, "target_table STRING").collect()
    assert {r.source_file: (r.target_table, r.error) for r in rows} == {
        "a": ("abc", None), "b": (None, "Exception: no"), "c": (None, "Returned None")}


def test_answers(spark):
    good = '{"target_table": "[d].[T]", "source_tables": ["[S]", null], "column_mappings": [], "joins": [], "filters": ["a = \'}\'"], "grouping": []}'
    rows = spark.createDataFrame([
        ("bare", good), ("fence", f"Sure:\n```json\n{good}\n```\nbye"), ("prose", f"see {good} and {{more}}"),
        ("second", f"{{bad}} {{worse: 1}} {good}"), ("nested", f"{{ not json {good} }}"), ("none", "no object"), ("open", '{"target_table": "x"'), ("blank", " "),
    ], "source_file STRING, response STRING").withColumn("method", F.lit("claude"))
    got = {r.source_file: r for r in A.parse_responses(rows).collect()}
    assert {k for k, r in got.items() if r.is_valid} == {"bare", "fence", "prose", "second", "nested"}
    assert got["fence"].target_table == "d.T" and got["prose"].source_tables == ["S"] and got["second"].filters == ["a = '}'"]


def test_files(spark, tmp):
    os.makedirs(f"{tmp}/sp/deep dir")
    for name, data in {"a.sql": b"\xef\xbb\xbfSELECT 1\r\n\xff-- x\r", "deep dir/b +1%.sql": b"SELECT 2", "blank.sql": b" \r\n", "note.txt": b"no"}.items():
        with open(f"{tmp}/sp/{name}", "wb") as f:
            f.write(data)
    assert {(r.source_file, r.txt) for r in files.read_scripts(spark, f"{tmp}/sp").collect()} == {
        ("a.sql", "SELECT 1\n-- x\n"), ("b +1%.sql", "SELECT 2")}
    with open(f"{tmp}/log.json", "w") as f:
        f.write('{"timestamp": "t", "source_file": "a"}\n\n{broken\n{"timestamp": "t", "source_file": "b"}\n')
    assert [r.source_file for r in files.read_failures(spark, f"{tmp}/log.json").orderBy("source_file").collect()] == ["a", "b"]
    assert files.read_store(spark, f"{tmp}/store") is None
    with pytest.raises(ValueError):
        files.checked(spark.createDataFrame([], "path STRING"), LINEAGE)
    doc = {"sp": {"a.sql": {"status": "success", "processed_at": "2024-01-01T00:00:00Z", "method": "regex"}},
           "schemas": {"t.sql": {"status": "success", "tables_found": 8, "processed_at": "2024-01-01T00:00:00Z"}}}
    with open(f"{tmp}/tracker.json", "w") as f:
        json.dump(doc, f, indent=2)
    rows = files.read_tracker_json(spark, f"{tmp}/tracker.json")
    assert {(r.kind, r.source_file, r.tables_found) for r in rows.collect()} == {("sp", "a.sql", None), ("schemas", "t.sql", 8)}


def test_shared_folder_comes_from_the_session(spark, tmp):
    assert shared.work_dir(spark) == shared.work_dir(spark)
    df = shared.materialise(spark.range(3), "three")
    assert df.count() == 3 and "FileScan" in df._jdf.queryExecution().toString()


def test_tracker(spark):
    old = spark.createDataFrame([("sp", "a", "success", "regex", "T", None, "2024-01-02T00:00:00Z"), ("sp", "b", "failed", "", "", None, "2024-01-01T00:00:00Z")], TRACKER)
    new = spark.createDataFrame([("sp", "b", "success", "claude", "U", None, "2024-01-03T00:00:00Z"), ("schemas", "t", "success", "", "", 4, "2024-01-03T00:00:00Z")], TRACKER)
    rows = {(r.kind, r.source_file): r for r in I.upsert(old, new).collect()}
    assert rows["sp", "b"].method == "claude" and rows["schemas", "t"].method is None and len(rows) == 3
    with pytest.raises(ValueError):
        I.run_results("other", old, new)


def test_incremental_run_equals_full_run(spark, tmp):
    texts = {"a.sql": GOOD, "b.sql": "INSERT INTO u SELECT t.a FROM t", "c.sql": "EXEC sp_executesql @x", "d.sql": "MERGE"}
    ddl = make_scripts(spark, {"t.sql": "CREATE TABLE dbo.T (a INT)"})
    empty = spark.createDataFrame([], TRACKER)
    answer = '{"target_table": "[dbo].[W]", "source_tables": ["dbo.T"], "column_mappings": [{"target_column": "a", "source_table": "dbo.T", "source_column": "a"}], "joins": []}'
    answers = spark.createDataFrame([("c.sql", "claude", answer)], "source_file STRING, method STRING, response STRING")

    def run(names, tracker, stored, stored_cat):
        return build.analyse(make_scripts(spark, {n: texts[n] for n in names}), ddl, tracker, overrides(spark), "claude",
                             ["regex", "claude"], "2024-01-01T00:00:00Z", answers, stored, stored_cat, F.lit("2024"))

    full = run(texts, empty, None, None)
    assert {r.source_file: (r.extraction_method, r.target_table) for r in full.records.collect()} == {
        "a.sql": ("regex", "T"), "b.sql": ("regex", "U"), "c.sql": ("claude", "W")}
    failed = full.failures.collect()
    assert [f.source_file for f in failed] == ["d.sql"] and failed[0].step1_error == "no_primary" and failed[0].sp_snippet == "MERGE"
    assert failed[0].step3_error.startswith("Skipped")

    twice = make_scripts(spark, {"two.sql": "INSERT INTO A SELECT s.x FROM S1 s; INSERT INTO B SELECT s.x, s.y FROM S2 s;"})
    each = build.analyse(twice, ddl, empty, overrides(spark), "claude", ["regex"], "2024", timestamp=F.lit("2024"), primary_only=False)
    assert {(r.target_table, *r.source_tables) for r in each.records.collect()} == {("A", "S1"), ("B", "S2")}

    one = run(["a.sql"], empty, None, None)
    files.write_store(one.records, one.catalogue, f"{tmp}/store")
    files.write_tracker(one.tracker, f"{tmp}/tracker")
    records, catalogue = files.read_store(spark, f"{tmp}/store")
    two = run(texts, files.read_tracker(spark, f"{tmp}/tracker"), records, catalogue)
    key = lambda df: sorted((r.source_file, r.target_table, r.extraction_method, str(r.column_mappings)) for r in df.collect())
    assert key(two.records) == key(full.records)
    assert {r.table_name for r in two.catalogue.collect()} == {"T"}
    assert {(r.kind, r.source_file, r.status) for r in two.tracker.collect()} == {
        ("sp", "a.sql", "success"), ("sp", "b.sql", "success"), ("sp", "c.sql", "success"), ("sp", "d.sql", "failed"), ("schemas", "t.sql", "success")}
    tables = build.graph_tables(two.records, two.catalogue)
    assert {(r.src, r.dst) for r in tables["edges"].collect()} == {("SRC", "T"), ("T", "U"), ("T", "W")}
    assert {r.id: r.in_catalogue for r in tables["nodes"].collect()}["T"] is True


def test_stream_picks_up_new_files_only(spark, tmp):
    root, out, state = f"{tmp}/in", f"{tmp}/out", f"{tmp}/state"
    corpus.write_files(make_scripts(spark, {"a.sql": GOOD}), root)
    ingest.ingest(ingest.stream_scripts(spark, root), out, state).awaitTermination()
    corpus.write_files(make_scripts(spark, {"b.sql": "INSERT INTO u SELECT t.a FROM t"}), root)
    ingest.ingest(ingest.stream_scripts(spark, root), out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.source_file, r.target_table, r.batch) for r in rows) == [("a.sql", "T", 0), ("b.sql", "U", 1)]


def test_answers_with_the_same_keys_stay_apart(spark):
    from headwater.operators import responses

    rows = [("x.sql", "m", '{"target_table": "T1", "procedure_name": "```"}'), ("x.sql", "m", 'so:\n```JSON5\n{"target_table": "T2"}\n```'), ("x.sql", "m", "no json here")]
    got = responses.parse_responses(spark.createDataFrame(rows, "source_file string, method string, response string")).collect()
    assert sorted((r.is_valid, r.target_table or "") for r in got) == [(False, ""), (True, "T1"), (True, "T2")]


def test_deeply_nested_comment(spark):
    from headwater.operators import records

    text = "/* a /* b /* c /* d /* e INSERT INTO FAKE SELECT x FROM FAKE2 */ */ */ */ */ INSERT INTO T SELECT s.a FROM S s"
    rows = records.extract_lineage(spark.createDataFrame([("m:/x.sql", "x.sql", text)], "path string, source_file string, txt string")).collect()
    assert [r.target_table for r in rows] == ["T"]

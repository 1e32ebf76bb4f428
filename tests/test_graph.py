"""Graph building, reach and traces on small graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from headwater.functions.skew import hot_keys, salted_join
from headwater.operators import graph as G
from headwater.operators import trace as C
from headwater.operators import traverse as B
from headwater.sources.schemas import LINEAGE


def record(name, target, sources, mappings=(), filters=(), procedure="P", method="regex"):
    maps = [(t, s, s, c, typ, c, None, None) for t, s, c, typ in mappings]
    key = lambda n: n.split(".")[-1].upper()
    return (name, name, procedure, key(target), target, [key(s) for s in sources], list(sources), maps, [], list(filters), [], method)


def edge_df(spark, pairs):
    return spark.createDataFrame(pairs, "src STRING, dst STRING")


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([
        record("1.sql", "dw.T", ["ods.A", "B"], [("X", "A", "X", "direct_copy"), ("Y", "", "q", "calculation")], ["A.x = 1"]),
        record("2.sql", "T", ["A"], [("X", "A", "X", "calculation"), ("Z", "", "1", "constant")], ["A.x = 1", "A.z = 2"], "Q", "gemini"),
        record("3.sql", "T", ["T"], [("X", "T", "X", "direct_copy")], procedure=""),
        record("4.sql", "LONE", []),
    ], LINEAGE)


def test_nodes_and_edges(records):
    assert {(r.id, r.display_name) for r in G.nodes(records).collect()} == {("T", "dw.T"), ("A", "ods.A"), ("B", "B"), ("LONE", "LONE")}
    assert {(r.src, r.dst, r.n_scripts) for r in G.edges(records).collect()} == {("A", "T", 2), ("B", "T", 1), ("T", "T", 1)}


def test_edge_facts_merge(records):
    merged = {(r.src, r.dst): r for r in G.edge_merge(records).collect()}
    a = merged["A", "T"]
    assert (a.n_mappings, a.n_filters, a.n_procedures, a.n_methods) == (3, 2, 2, 2)
    assert merged["T", "T"].n_procedures == 0
    first = [r for r in G.edge_facts(records).collect() if r.src == "A" and r.kind == "mapping" and r.k1 == "X"]
    assert len(first) == 1 and "direct_copy" in first[0].detail


def test_statistics(records, spark):
    failed = spark.createDataFrame([("x.sql",)], "source_file STRING")
    stats = {r.metric: r.value for r in G.statistics(records, failed).collect()}
    assert stats == {"total_tables": 4, "total_edges": 3, "source_tables": 2, "target_tables": 0, "procedures": 2, "edges_regex": 3,
                     "edges_claude": 0, "edges_gemini": 1, "edges_nvidia": 0, "failed": 1}


def test_column_edges(records):
    rows = {(r.src_table, r.src_col, r.dst_col, r.type) for r in G.column_edges(records).collect()}
    assert rows == {("A", "X", "X", "direct_copy"), ("A", "q", "Y", "calculation"), ("B", "q", "Y", "calculation"),
                    ("(constant)", "1", "Z", "constant"), ("T", "X", "X", "direct_copy")}


def test_raw_and_outgoing(records, spark):
    cat = spark.createDataFrame([], "table_name STRING, qualified_name STRING, database STRING, schema STRING, "
                                "columns ARRAY<STRUCT<name:STRING,type:STRING,nullable:BOOLEAN,primary_key:BOOLEAN>>, source_file STRING")
    enriched = G.enrich(G.nodes(records), cat)
    assert {r.schema for r in enriched.collect()} == {"dbo"}
    assert {r.id for r in G.raw_tables(enriched, G.edges(records)).collect()} == {"A", "B", "LONE"}
    out = {(r.src_table, r.src_col, r.dst_col, r.is_own) for r in G.column_outgoing(records, spark.createDataFrame([("B",)], "id STRING")).collect()}
    assert out == {("A", "X", "X", False), ("", "q", "Y", True)}


DIAMOND = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"), ("D", "D")]


def test_diamond(spark):
    e = edge_df(spark, DIAMOND)
    seeds = spark.createDataFrame([("[dbo].[a]",), ("nowhere",)], "seed STRING")
    reach = B.downstream(e, seeds, 2)
    assert {(r.seed, r.node, r.hop) for r in reach.collect()} == {("A", "A", 0), ("A", "B", 1), ("A", "C", 1), ("A", "D", 2)}
    induced = {(r.src, r.dst) for r in B.reach_edges(e, reach, "downstream").collect()}
    tree = {(r.src, r.dst) for r in B.reach_edges(e, reach, "downstream", "tree").collect()}
    assert induced == set(DIAMOND) - {("D", "D")} and tree == {("A", "B"), ("A", "C"), ("B", "D")} and tree <= induced


def test_facts_of_a_reach_with_a_hot_edge(spark):
    reached = spark.createDataFrame([("s", "A", "B"), ("t", "A", "B"), ("s", "B", "C"), ("s", "C", "D")], "seed STRING, src STRING, dst STRING")
    facts = spark.createDataFrame([("A", "B", f"f{i}") for i in range(40)] + [("B", "C", "g"), ("X", "Y", "h")], "src STRING, dst STRING, k1 STRING")
    want = {(seed, "A", "B", f"f{i}") for seed in "st" for i in range(40)} | {("s", "B", "C", "g")}
    got = [(r.seed, r.src, r.dst, r.k1) for r in B.with_facts(reached, facts, hot_rows=10).collect()]
    assert len(got) == len(want) and set(got) == want


def brute_reach(pairs, seed, depth):
    hops, frontier = {seed: 0}, {seed}
    for h in range(1, depth + 1):
        frontier = {b for a, b in pairs if a in frontier and b not in hops}
        hops.update({n: h for n in frontier})
    return hops


def test_reach_against_brute_force_with_hub(spark):
    rng = random.Random(7)
    names = [f"N{i}" for i in range(40)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(70)} | {("HUB", n) for n in names} | {("N0", "HUB")})
    e = edge_df(spark, pairs)
    seeds = spark.createDataFrame([(n,) for n in names], "seed STRING")
    got = {}
    for r in B.downstream(e, seeds, 4, hot_rows=10).collect():
        got.setdefault(r.seed, {})[r.node] = r.hop
    known = {n for p in pairs for n in p}
    assert got == {n: brute_reach(pairs, n, 4) for n in names if n in known}


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate("aabbc")], "k STRING, l INT")
    right = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 2), ("d", 3)], "k STRING, r INT")
    hot = hot_keys(right, ["k"], min_rows=50)
    assert [h.k for h in hot] == ["a"]
    plain = sorted(map(tuple, left.join(right, "k").select("k", "l", "r").collect()))
    assert sorted(map(tuple, salted_join(left, right, ["k"], hot, 4).select("k", "l", "r").collect())) == plain


COLS = [("A", "x", "B", "y"), ("R", "x", "A", "x"), ("B", "y", "C", "z"), ("C", "z", "B", "y"), ("(constant)", "1", "C", "k"), ("B", "y", "D", "w")]


def brute_out(start, limit=20):
    def go(at, seen, depth):
        if depth > limit:
            return [[at]]
        if at in seen:
            return [[at]]
        nxt = [(c[2], c[3]) for c in COLS if (c[0], c[1]) == at]
        return [[at] + rest for n in nxt for rest in go(n, seen | {at}, depth + 1)] if nxt else [[at]]
    return {"|".join(".".join(k) for k in path) for path in go(start, frozenset(), 0)}


def test_traces(spark):
    ce = spark.createDataFrame([(*c, "direct_copy") for c in COLS], "src_table STRING, src_col STRING, dst_table STRING, dst_col STRING, type STRING")
    seeds = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "k"), ("B", "none")], "table STRING, column STRING")
    raw = spark.createDataFrame([("R",)], "id STRING")
    for hot_rows in (100, 1):
        out = {}
        for r in C.trace_outbound(ce, seeds, hot_rows=hot_rows).collect():
            out.setdefault((r.seed_table, r.seed_column), set()).add(r.chain)
        assert out == {s: brute_out(s) for s in [("A", "x"), ("B", "y"), ("C", "k"), ("B", "none")]}
    chains = C.trace_inbound(ce, seeds, raw)
    got = {(r.seed_table, r.seed_column, r.chain): r.steps[-1] for r in chains.collect()}
    assert set(got) == {("A", "x", "A.x|R.x"), ("B", "y", "B.y|A.x|R.x"), ("B", "y", "B.y|C.z|B.y"), ("C", "k", "C.k|(constant).1"),
                        ("B", "none", "B.none")}
    assert got["A", "x", "A.x|R.x"].note == "raw origin" and got["C", "k", "C.k|(constant).1"].note == "constant"
    assert got["B", "y", "B.y|C.z|B.y"].type == "cycle_detected" and got["B", "none", "B.none"].type == "unknown"
    assert "(constant)" not in {r.table_name for r in C.trace_tables(chains).collect()}


def test_traces_know_the_tables_of_the_graph(spark):
    ce = spark.createDataFrame([("M", "x", "T", "y", "direct_copy"), ("NOPE", "z", "T", "w", "direct_copy")],
                               "src_table STRING, src_col STRING, dst_table STRING, dst_col STRING, type STRING")
    tables = spark.createDataFrame([("M",), ("T",), ("R",)], "id STRING")
    seeds = spark.createDataFrame([("T", "y"), ("T", "w"), ("elsewhere", "z")], "table STRING, column STRING")
    raw = spark.createDataFrame([("R",)], "id STRING")
    got = {r.chain: r.steps[-1].note for r in C.trace_inbound(ce, seeds, raw, tables=tables).collect()}
    assert got == {"T.y|M.x": "no incoming mappings", "T.w|NOPE.z": "raw origin"}
    out = C.trace_outbound(ce, seeds.union(spark.createDataFrame([("m", "x")], seeds.schema)), tables=tables)
    assert {r.chain for r in out.collect()} == {"T.y", "T.w", "M.x|T.y"}


def test_depth_limit(spark):
    ce = spark.createDataFrame([(f"T{i}", "c", f"T{i + 1}", "c", "direct_copy") for i in range(30)],
                               "src_table STRING, src_col STRING, dst_table STRING, dst_col STRING, type STRING")
    seeds = spark.createDataFrame([("T0", "c")], "table STRING, column STRING")
    row = C.trace_outbound(ce, seeds, max_depth=3).first()
    assert [s.table for s in row.steps] == ["T0", "T1", "T2", "T3", "T4"] and "max depth" in row.steps[-1].note


COLUMN_EDGES = "src_table STRING, src_col STRING, dst_table STRING, dst_col STRING, type STRING"


def test_trace_graph_has_what_the_chains_run_over(spark):
    ce = spark.createDataFrame([(*c, "direct_copy") for c in COLS], COLUMN_EDGES)
    seeds = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "k"), ("B", "none")], "table STRING, column STRING")
    raw = spark.createDataFrame([("R",)], "id STRING")
    for hot_rows in (100, 1):
        pairs = [(C.trace_outbound(ce, seeds), C.outbound_graph(ce, seeds, hot_rows=hot_rows)),
                 (C.trace_inbound(ce, seeds, raw), C.inbound_graph(ce, seeds, raw, hot_rows=hot_rows))]
        for chains, (nodes, steps) in pairs:
            listed = {(r.seed_table, r.seed_column): set() for r in chains.collect()}
            arcs = set()
            for r in chains.collect():
                path = r.chain.split("|")
                listed[r.seed_table, r.seed_column] |= set(path)
                arcs |= {(r.seed_table, r.seed_column, a, b) for a, b in zip(path, path[1:])}
            found = {}
            for r in nodes.collect():
                found.setdefault((r.seed_table, r.seed_column), set()).add(f"{r.table}.{r.column}")
            assert found == listed
            assert {(r.seed_table, r.seed_column, f"{r.at_table}.{r.at_col}", f"{r.to_table}.{r.to_col}") for r in steps.collect()} == arcs
            assert set(C.graph_tables(nodes).collect()) == set(C.trace_tables(chains).collect())


def test_trace_graph_of_diamonds_does_not_multiply(spark):
    """Twelve diamonds in a row: 4096 chains, 37 columns, 48 steps."""
    rows = [(f"T{i}", "c", f"{side}{i}", "c", "direct_copy") for i in range(12) for side in "LR"]
    rows += [(f"{side}{i}", "c", f"T{i + 1}", "c", "direct_copy") for i in range(12) for side in "LR"]
    ce = spark.createDataFrame(rows, COLUMN_EDGES)
    seeds = spark.createDataFrame([("T0", "c"), ("elsewhere", "c")], "table STRING, column STRING")
    tables = ce.select(F.explode(F.array("src_table", "dst_table")).alias("id"))
    nodes, steps = C.outbound_graph(ce, seeds, max_depth=40, tables=tables)
    assert (nodes.count(), steps.count()) == (37, 48)
    assert {r.hop for r in nodes.filter("table = 'T12'").collect()} == {24}
    nodes, steps = C.outbound_graph(ce, seeds, max_depth=3)
    assert {r.table for r in nodes.collect()} == {"T0", "L0", "R0", "T1", "L1", "R1", "T2", "ELSEWHERE"} and steps.count() == 8


def test_start_tables_without_edges(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("H", "A")], "src STRING, dst STRING")
    seeds = spark.createDataFrame([("b",), ("alone",), ("unknown",)], "seed STRING")
    tables = spark.createDataFrame([(t,) for t in ("A", "B", "C", "H", "ALONE")], "id STRING")
    nodes, kept = B.lineage(edges, seeds, tables=tables)
    assert {tuple(r) for r in nodes.collect()} == {("B", "B", 0), ("B", "A", -1), ("B", "H", -2), ("B", "C", 1), ("ALONE", "ALONE", 0)}
    assert {tuple(r) for r in kept.collect()} == {("B", "A", "B"), ("B", "H", "A"), ("B", "B", "C")}
    assert {r.seed for r in B.upstream(edges, seeds).collect()} == {"B"}


def test_edges_of_a_hub_are_spread(spark):
    edges = spark.createDataFrame([("HUB", f"T{i}") for i in range(300)] + [(f"T{i}", "END") for i in range(40)] + [("S", "HUB")], "src STRING, dst STRING")
    seeds = spark.createDataFrame([("S",), ("END",)], "seed STRING")
    plain, spread = (B.lineage(edges, seeds, depth=3, hot_rows=n) for n in (10_000, 50))
    for a, b in zip(plain, spread):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert plain[1].filter("seed = 'S'").count() == 341


def test_a_hub_is_not_met_with_all_its_edges(spark):
    """A table that feeds many others holds none of those edges in the look-up; the edges of every reach are those of plain Python."""
    pairs = [("HUB", f"T{i}") for i in range(60)] + [(f"T{i // 2}", f"T{i}") for i in range(1, 60)] + [(f"T{i}", "SINK") for i in range(60)]
    edges = edge_df(spark, pairs)
    step = edges.filter("src <> dst").distinct()
    held = {r["at"]: r["count"] for r in B._at_lesser_end(step, 100_000).groupBy("at").count().collect()}
    assert "HUB" not in held and "SINK" not in held and max(held.values()) <= 4
    assert sum(held.values()) == step.count()
    seeds = spark.createDataFrame([("HUB",), ("SINK",), ("T7",), ("T59",)], "seed STRING")
    for reach, way in ((B.upstream(edges, seeds, 2), "upstream"), (B.downstream(edges, seeds, 2), "downstream")):
        nodes = {}
        for r in reach.collect():
            nodes.setdefault(r.seed, set()).add(r.node)
        wanted = sorted((s, a, b) for s, found in nodes.items() for a, b in set(pairs) if a != b and {a, b} <= found)
        for hot_rows in (100_000, 3):
            assert sorted(map(tuple, B.reach_edges(edges, reach, way, hot_rows=hot_rows).collect())) == wanted


def test_steps_are_cut_from_the_text_of_a_path(spark):
    """Names with dots, bars and letters of several bytes; a text that looks like a visited column is none."""
    ce = spark.createDataFrame([
        ("A", "x|Y.z", "B", "ü€.c", "calculation"), ("B", "ü€.c", "Y", "z", ""), ("Y", "z", "B", "ü€.c", "𝔘nion"), ("Y", "z", "W", "w", None),
    ], COLUMN_EDGES)
    seeds = spark.createDataFrame([("É.A", "x|Y.z")], "table STRING, column STRING")
    chains = C.trace_outbound(ce, seeds)
    got = {r.chain: [tuple(s) for s in r.steps] for r in chains.collect()}
    head = [("A", "x|Y.z", "calculation", False, None), ("B", "ü€.c", "direct_copy", False, None)]
    assert got == {
        "A.x|Y.z|B.ü€.c|Y.z|B.ü€.c": [*head, ("Y", "z", "𝔘nion", False, None), ("B", "ü€.c", "cycle_detected", False, "cycle detected")],
        "A.x|Y.z|B.ü€.c|Y.z|W.w": [*head, ("Y", "z", "direct_copy", False, None), ("W", "w", "leaf", True, "Not consumed by any other table")]}
    assert {(r.n_steps, r["last"].table) for r in chains.collect()} == {(4, "B"), (4, "W")}
    short = chains.select("chain", "n_steps", "last")
    assert "transform" not in short._jdf.queryExecution().optimizedPlan().toString()

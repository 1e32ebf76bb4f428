"""Registered queries: each reads the given tables or collections derived from them, whole."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import names as N
from ..functions.shared import materialise, new_path
from ..operators import catalogue as K
from ..operators import facts as X
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import records as R
from ..operators import responses as A
from ..operators import routing as M
from ..operators import statements as S
from ..operators import trace as C
from ..operators import traverse as B
from ..sources import corpus, files, store
from ..streaming import ingest
from . import keep

_BUILT: dict[tuple[str, str, str], DataFrame] = {}
STAMP = "2024-06-01T00:00:00Z"


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """Write a table the first time it is asked for in this application, then read it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = materialise(make(), name)
    return _BUILT[key]


def _extracted(spark, d):
    return _once(spark, d, "extracted", lambda: R.extract_lineage(corpus.scripts(spark, d)))


def _records(spark, d):
    return R.normalise(_extracted(spark, d).filter("failure is null").drop("failure", "stmt_no"))


def _failures(spark, d):
    return _extracted(spark, d).filter("failure is not null")


def _catalogue(spark, d):
    return K.latest(K.tables(corpus.ddl(spark, d)))


def _csv(c) -> Column:
    return F.array_join(F.array_sort(c), ",")


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# Sources and sinks

def scan_scripts(spark, d):
    root = new_path(spark, "scripts")
    corpus.write_files(corpus.scripts(spark, d), root)
    return files.read_scripts(spark, root).select("source_file", F.length("txt").cast("bigint").alias("n_chars"))


def scan_ddl(spark, d):
    root = new_path(spark, "ddl")
    corpus.write_files(corpus.ddl(spark, d), root)
    return files.read_ddl(spark, root).select("source_file", F.length("txt").cast("bigint").alias("n_chars"))


def store_roundtrip(spark, d):
    root = new_path(spark, "store")
    files.write_store(_records(spark, d), _catalogue(spark, d), root)
    records, catalogue = files.read_store(spark, root)
    return records.select(F.lit("record").alias("part"), F.col("source_file").alias("id"), F.size("column_mappings").cast("bigint").alias("n")).unionByName(
        catalogue.select(F.lit("table").alias("part"), F.col("table_name").alias("id"), F.size("columns").cast("bigint").alias("n")))


# Scalar helpers

def norm_table(spark, d):
    return corpus.table(spark, d, "customer").select(F.explode(F.array(
        F.concat(F.lit(" [Db].[dbo].["), F.col("c_name"), F.lit("]")), F.concat(F.lit('"Db"."'), F.col("c_name"), F.lit('"')),
        F.concat(F.lit("dbo."), F.col("c_name")), F.concat(F.lit("["), F.col("c_mktsegment"), F.lit(" "), F.col("c_name"), F.lit("]")),
    )).alias("raw")).select("raw", N.table_key(F.col("raw")).alias("result"))


def strip_brackets(spark, d):
    return corpus.table(spark, d, "pages").select(
        F.concat(F.lit("[a].["), F.col("url"), F.lit("]")).alias("raw")).select("raw", N.drop_brackets(F.col("raw")).alias("result"))


def split_qualified(spark, d):
    c = F.col("c_name")
    rows = corpus.table(spark, d, "customer").select(F.explode(F.array(
        F.concat(F.lit("[S.rv].[Db].[x y].["), c, F.lit("]")), F.concat(F.lit('dbo."'), c, F.lit('"')), c,
        F.concat(F.lit("`Db`.dbo.["), F.col("c_mktsegment"), F.lit(".x]")))).alias("raw"))
    parts = N.db_schema_table(F.col("raw"))
    null = lambda x: F.coalesce(x, F.lit(""))
    return rows.select("raw", null(parts["db"]).alias("db"), null(parts["schema"]).alias("schema"), parts["table_name"].alias("table_name"))


def classify_expr(spark, d):
    rows = R.resolved_items(corpus.scripts(spark, d)).filter(F.col("fact") == X.SELECT)
    return rows.select(F.col("path").alias("source_file"), *_big("item_no"), E.classify(F.col("raw_text")).alias("transformation_type"),
                       E.is_constant(F.col("raw_text")).alias("is_constant"))


def resolve_alias(spark, d):
    """Select expressions with alias prefixes replaced; own column without its prefix."""
    rows = R.resolved_items(corpus.scripts(spark, d)).filter(F.col("fact") == X.SELECT)
    return rows.select(F.col("path").alias("source_file"), *_big("item_no"), F.col("text").alias("resolved"))


# Tokens and statements

def clean_scripts(spark, d):
    """Tokens left per script once comments and session noise are gone."""
    rows = S.statement_tokens(corpus.scripts(spark, d)).filter(F.col("word").isin(*S.DML, "SELECT", "WITH"))
    return rows.groupBy(F.col("path").alias("source_file")).agg(F.count(F.lit(1)).alias("n_tokens"))


def _items(spark, d, letter):
    return R.resolved_items(corpus.scripts(spark, d)).filter(F.col("fact") == letter)


def split_commas(spark, d):
    return _items(spark, d, X.SELECT).select(F.col("path").alias("source_file"), *_big("item_no"), F.col("raw_text").alias("item"))


def split_predicates(spark, d):
    return _items(spark, d, X.WHERE).select(
        F.col("path").alias("source_file"), *_big("item_no"), F.col("raw_text").alias("item"),
        F.when(F.col("item_no") > 0, F.col("connective")).otherwise("").alias("connective"))


def clause_bounds(spark, d):
    """Tokens per depth-0 clause of the primary statement."""
    rows = X.level_rows(corpus.scripts(spark, d)).filter("level = 0 and ev.word is not null")
    return rows.groupBy(F.col("path").alias("source_file"), F.col("ev.word").alias("clause")).agg(F.count(F.lit(1)).alias("n_tokens"))


def statements(spark, d):
    return S.statements(corpus.scripts(spark, d)).select(
        F.col("path").alias("source_file"), *_big("stmt_no"), "type", "has_select", F.length("text").cast("bigint").alias("n_chars"))


def primary_stmt(spark, d):
    return S.primary_statement(S.statements(corpus.scripts(spark, d))).select(
        F.col("path").alias("source_file"), *_big("stmt_no"), "type")


def procedure_names(spark, d):
    return corpus.scripts(spark, d).select("source_file", S.procedure_name(F.col("txt")).alias("procedure_name"))


def target_tables(spark, d):
    return R.statement_facts(corpus.scripts(spark, d)).select(F.col("path").alias("source_file"), "target_table")


def source_tables(spark, d):
    return R.source_tables(corpus.scripts(spark, d)).select(F.col("path").alias("source_file"), "target_table", "source_table")


def alias_map(spark, d):
    return R.aliases(corpus.scripts(spark, d)).select(F.col("path").alias("source_file"), "alias", "table_name")


def column_mappings(spark, d):
    return R.column_mappings(R.lineage_records(corpus.scripts(spark, d))).select(
        "source_file", *_big("seq"), "target_column", "source_table", "source_column", "transformation_type", "transformation_logic")


def column_origins(spark, d):
    """Base columns behind columns of derived tables and common table expressions."""
    return R.column_mappings(R.lineage_records(corpus.nested_scripts(spark, d))).select(
        "source_file", "target_column", "source_table", "source_column", "transformation_type")


def join_facts(spark, d):
    return R.joins(R.lineage_records(corpus.scripts(spark, d))).select(
        "source_file", *_big("seq"), "left_table", "right_table", "join_type", "condition")


def filter_facts(spark, d):
    return R.filters(corpus.scripts(spark, d)).select(
        F.col("path").alias("source_file"), *_big("seq"), "clause", F.coalesce("connective", F.lit("")).alias("connective"), "condition")


def grouping_facts(spark, d):
    return R.grouping(corpus.scripts(spark, d)).select(F.col("path").alias("source_file"), *_big("seq"), "item")


def _summary(rows: DataFrame, *more: str) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(f"n_{c}")
    return rows.select("source_file", "procedure_name", "target_table", _csv("source_tables").alias("sources_csv"),
                       n("column_mappings"), n("joins"), n("filters"), n("grouping"), *more)


def lineage_records(spark, d):
    rows = R.extract_lineage(corpus.scripts(spark, d))
    return _summary(rows, "failure").na.fill("")


def lineage_normalised(spark, d):
    return _summary(_records(spark, d))


def lineage_qualified(spark, d):
    """Records with target and sources by their whole names."""
    found = _extracted(spark, d).filter("failure is null").drop("failure", "stmt_no")
    return R.normalise(found, keep_qualified=True).select(
        "source_file", "target_table", "target_table_qualified", _csv(F.col("source_tables_qualified")).alias("sources_csv"))


def statement_records(spark, d):
    """One record per statement that yields lineage, not only the primary one."""
    rows = R.extract_lineage(corpus.scripts(spark, d), primary_only=False)
    return rows.filter("failure is null").select("source_file", "target_table", _csv("source_tables").alias("sources_csv"))


# Complexity, routing, attempts

def complexity_signals(spark, d):
    return M.signals(corpus.scripts(spark, d)).drop("path")


def complexity_score(spark, d):
    return M.score(M.signals(corpus.scripts(spark, d))).select("source_file", "score")


def complexity_reasons(spark, d):
    return M.score(M.signals(corpus.scripts(spark, d))).select("source_file", F.array_join("reasons", "; ").alias("reasons"))


def overrides_valid(spark, d):
    return M.valid_overrides(corpus.overrides(spark, d)).select("source_file", "method", *_big("priority"))


def overrides_merged(spark, d):
    return M.merge_overrides(corpus.overrides(spark, d))


def _routed(spark, d):
    return M.route(M.recommend(M.score(M.signals(corpus.scripts(spark, d))), "claude"), corpus.overrides(spark, d))


def route_methods(spark, d):
    return _routed(spark, d).select("source_file", "method", "is_override")


def route_counts(spark, d):
    return _routed(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


AVAILABLE = ["regex", "claude", "gemini"]


def attempt_plan(spark, d):
    return M.attempts(_routed(spark, d), AVAILABLE).select("source_file", *_big("rank"), "method", "available")


def _candidates(spark, d):
    text = _extracted(spark, d).select("path", F.lit("regex").alias("method"), F.col("failure").alias("error"))
    model = A.parse_responses(corpus.answers(spark, d), ["conv_id", "turn", "source_file", "method"]).select(
        F.col("source_file").alias("path"), "method", F.when(~F.col("is_valid"), "no valid answer").alias("error"))
    return text.unionByName(model)


def _waterfall(spark, d):
    return M.waterfall(M.attempts(_routed(spark, d), AVAILABLE), _candidates(spark, d))


def waterfall(spark, d):
    return _waterfall(spark, d)[0].select("source_file", "method")


def run_summary(spark, d):
    won, failed = _waterfall(spark, d)
    return G.run_summary(won.withColumnRenamed("method", "extraction_method"), failed)


def failures_log(spark, d):
    """Append the failures to a JSON log, read it back."""
    log = new_path(spark, "failures")
    texts = corpus.scripts(spark, d).select("path", E.snippet(F.col("txt")).alias("sp_snippet"))
    files.append_failures(M.failure_records(_waterfall(spark, d)[1], texts, F.lit(STAMP)), log)
    return files.read_failures(spark, log).select(
        "timestamp", "source_file", "failure_reason", "step1_error", "step2_error", "step3_error", "step4_error", "sp_snippet")


def responses_parse(spark, d):
    rows = A.parse_responses(corpus.answers(spark, d), ["conv_id", "turn"])
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "conv_id", "turn", "is_valid", text(F.col("target_table")).alias("target_table"), text(F.array_join("source_tables", ",")).alias("sources_csv"),
        text(F.try_element_at("filters", F.lit(1))).alias("first_filter"),
        text(F.try_element_at("column_mappings", F.lit(1))["source_column"]).alias("first_source_column"))


# Catalogue

def ddl_tables(spark, d):
    return K.tables(corpus.ddl(spark, d)).select("source_file", "table_name", "qualified_name", "database", "schema", F.size("columns").cast("bigint").alias("n_columns"))


def ddl_columns(spark, d):
    return K.columns(K.tables(corpus.ddl(spark, d))).select("source_file", "table_name", *_big("column_no"), "name", "type", "nullable", "primary_key")


def ddl_primary_keys(spark, d):
    return K.columns(K.tables(corpus.ddl(spark, d))).filter("primary_key").select("source_file", "table_name", "name")


def catalogue_latest(spark, d):
    return _catalogue(spark, d).select("table_name", "source_file", F.size("columns").cast("bigint").alias("n_columns"))


def ddl_tables_found(spark, d):
    ddl = corpus.ddl(spark, d)
    return K.tables_found(ddl, K.tables(ddl)).select("source_file", "tables_found")


def catalogue_digest(spark, d):
    return K.digest(_catalogue(spark, d))


# Graph

def edges(spark, d):
    return G.edges(_records(spark, d))


def nodes(spark, d):
    return G.nodes(_records(spark, d))


def nodes_enriched(spark, d):
    return G.enrich(G.nodes(_records(spark, d)), _catalogue(spark, d)).select(
        "id", "display_name", "schema", "database", "qualified_name", F.array_join("columns", ",").alias("columns_csv"), "in_catalogue")


def edge_merge(spark, d):
    """Edges of the records and of the same records found by a model: facts merge, methods add up."""
    records = _records(spark, d)
    return G.edge_merge(records.unionByName(records.withColumn("extraction_method", F.lit("gemini"))))


def column_edges(spark, d):
    return G.column_edges(_records(spark, d)).select("src_table", "src_col", "dst_table", "dst_col", "type")


def graph_degrees(spark, d):
    return G.degrees(corpus.flow_edges(spark, d))


def node_kinds(spark, d):
    records = _records(spark, d)
    return G.node_kinds(G.nodes(records), G.edges(records))


def graph_stats(spark, d):
    return G.statistics(_records(spark, d), _failures(spark, d))


def graph_export(spark, d):
    records = _records(spark, d)
    lines = G.export_lines(G.enrich(G.nodes(records), _catalogue(spark, d)), G.edges(records), G.edge_facts(records))
    root = new_path(spark, "graph")
    files.write_graph(lines, root)
    back = spark.read.text(root)
    key = lambda f: F.get_json_object("value", f)
    return back.select("kind", F.coalesce(key("$.id"), F.concat_ws(">", key("$.source"), key("$.target"))).alias("key"),
                       F.coalesce(key("$.label"), key("$.kind"), F.lit("")).alias("label")).groupBy("kind", "key", "label").agg(
        F.count(F.lit(1)).alias("n"))


def all_tables(spark, d):
    return G.nodes(_records(spark, d)).select("id").orderBy("id")


def raw_tables(spark, d):
    records = _records(spark, d)
    return G.raw_tables(G.enrich(G.nodes(records), _catalogue(spark, d)), G.edges(records))


def _all_seeds(edge_table):
    return edge_table.select(F.explode(F.array("src", "dst")).alias("seed")).distinct()


def upstream(spark, d):
    e = G.edges(_records(spark, d))
    return B.upstream(e, _all_seeds(e)).select("seed", "node", *_big("hop"))


def downstream(spark, d):
    e = G.edges(_records(spark, d))
    return B.downstream(e, _all_seeds(e)).select("seed", "node", *_big("hop"))


def upstream_flow(spark, d):
    """Everything that flows into each region: a few seeds reach the whole graph."""
    seeds = corpus.table(spark, d, "region").select(F.concat(F.lit("REGION_"), F.col("r_regionkey").cast("string")).alias("seed"))
    return B.upstream(corpus.flow_edges(spark, d), seeds, 4).select("seed", "node", *_big("hop"))


def downstream_cycles(spark, d):
    e = corpus.cycle_edges(spark, d)
    return B.downstream(e, _all_seeds(e), 3).select("seed", "node", *_big("hop"))


def lineage_both(spark, d):
    e = G.edges(_records(spark, d))
    return B.lineage(e, _all_seeds(e), 2)[1]


def lineage_tree(spark, d):
    """Discovery edges only: each node keeps the smallest neighbour that led to it."""
    e = corpus.cycle_edges(spark, d)
    return B.reach_edges(e, B.downstream(e, _all_seeds(e), 3), "downstream", "tree")


def lineage_facts(spark, d):
    """Edges between tables within two hops of a seed, with the number of their facts."""
    records = _records(spark, d)
    e = G.edges(records)
    rows = B.with_facts(B.lineage(e, _all_seeds(e), 2)[1], G.edge_facts(records))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.groupBy("seed", "src", "dst").agg(
        n("mapping").alias("n_mappings"), n("join").alias("n_joins"), n("filter").alias("n_filters"), n("grouping").alias("n_grouping"))


def lineage_attributes(spark, d):
    """Reach within two hops with node attributes attached."""
    records = _records(spark, d)
    e = G.edges(records)
    reach = B.lineage(e, _all_seeds(e), 2)[0]
    return B.with_attributes(reach, G.enrich(G.nodes(records), _catalogue(spark, d))).select("seed", "node", *_big("hop"), "in_catalogue")


def column_incoming(spark, d):
    records = _records(spark, d)
    return G.column_incoming(G.column_edges(records), G.nodes(records)).select("dst_table", "src_table", "src_col", "dst_col", "type")


def column_outgoing(spark, d):
    records = _records(spark, d)
    return G.column_outgoing(records, G.nodes(records))


def _chains(chains):
    last = F.col("last")
    return chains.select("seed_table", "seed_column", "chain", *_big("n_steps"),
                         F.coalesce(last["note"], F.lit("")).alias("note"), last["leaf"].alias("leaf"))


def _ends(col_edges, side):
    return col_edges.select(F.col(f"{side}_table").alias("table"), F.col(f"{side}_col").alias("column")).distinct()


def trace_inbound(spark, d):
    """Every column of the part tree back to the root table."""
    ce = corpus.tree_columns(spark, d)
    raw = ce.select(F.col("src_table").alias("id")).distinct().join(
        ce.select(F.col("dst_table").alias("id")).distinct(), "id", "left_anti")
    return _chains(C.trace_inbound(ce, _ends(ce, "dst"), raw))


def trace_inbound_scripts(spark, d):
    """Every column written by a script back to raw tables, constants and unread columns."""
    records = _records(spark, d)
    ce = G.column_edges(records)
    e = G.edges(records)
    return _chains(C.trace_inbound(ce, _ends(ce, "dst"), G.raw_tables(G.enrich(G.nodes(records), _catalogue(spark, d)), e)))


def trace_outbound(spark, d):
    ce = corpus.tree_columns(spark, d)
    return _chains(C.trace_outbound(ce, _ends(ce, "src")))


def trace_cycles(spark, d):
    """Outbound over cyclic columns: paths end where they close or at the depth limit."""
    ce = corpus.cycle_columns(spark, d)
    return _chains(C.trace_outbound(ce, _ends(ce, "src")))


def trace_tables(spark, d):
    ce = corpus.tree_columns(spark, d)
    return C.graph_tables(C.outbound_graph(ce, _ends(ce, "src"))[0])


def trace_graph(spark, d):
    """Columns and steps in reach of every column of the cycles; tables that the graph does not hold have none."""
    ce = corpus.cycle_columns(spark, d)
    absent = corpus.table(spark, d, "nation").select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("table"), F.lit("C_0").alias("column"))
    tables = ce.select(F.explode(F.array("src_table", "dst_table")).alias("id")).distinct()
    nodes, steps = C.outbound_graph(ce, _ends(ce, "src").unionByName(absent), tables=tables)
    count = lambda df, name: df.groupBy("seed_table", "seed_column").agg(F.count(F.lit(1)).alias(name))
    return count(nodes, "n_columns").join(count(steps, "n_steps"), ["seed_table", "seed_column"])


# Incremental

def _tracker(spark, d):
    done = corpus.order_outcomes(spark, d, "part", "sp_", I.SCRIPT)
    ddl = corpus.order_outcomes(spark, d, "supplier", "ddl_", I.SCHEMA)
    both = done.unionByName(ddl)
    return I.upsert(both.filter("status = 'success'"), both.filter("status = 'failed'"))


def tracker_upsert(spark, d):
    return _tracker(spark, d).select("kind", "source_file", "status", F.coalesce("method", F.lit("")).alias("method"), "processed_at")


def tracker_roundtrip(spark, d):
    root = new_path(spark, "tracker")
    files.write_tracker(_tracker(spark, d), root)
    return files.read_tracker(spark, root).select("kind", "source_file", "status", "processed_at")


def tracker_counts(spark, d):
    return I.counts(_tracker(spark, d), corpus.scripts(spark, d), corpus.ddl(spark, d))


def pending_scripts(spark, d):
    return I.pending(corpus.scripts(spark, d), _tracker(spark, d)).select("source_file")


def pending_ddl(spark, d):
    return I.pending(corpus.ddl(spark, d), _tracker(spark, d), I.SCHEMA).select("source_file")


def merge_results(spark, d):
    """Records of pending scripts over stored records of a model run."""
    records = _records(spark, d)
    fresh = I.pending(records, _tracker(spark, d))
    return I.run_results("refresh", records.withColumn("extraction_method", F.lit("gemini")), fresh).select(
        "source_file", "target_table", "extraction_method")


def stream_ingest(spark, d):
    root, out, state = (new_path(spark, n) for n in ("incoming", "ingested", "progress"))
    corpus.write_files(corpus.scripts(spark, d), root)
    ingest.ingest(ingest.stream_scripts(spark, root), out, state).awaitTermination()
    return spark.read.parquet(out).select("source_file", F.coalesce("target_table", F.lit("")).alias("target_table"), F.coalesce("failure", F.lit("")).alias("failure"))


def _folder_tracker(spark, d):
    rows = corpus.folder_outcomes(spark, d, "part", "sp_", I.SCRIPT)
    return I.upsert(rows.filter("status = 'success'"), rows.filter("status = 'failed'"))


def pending_by_path(spark, d):
    """Pending scripts where each name is in two folders."""
    return I.pending(corpus.in_folders(corpus.scripts(spark, d)), _folder_tracker(spark, d)).select("path")


def merge_by_path(spark, d):
    """Records of pending paths over stored records of a model run, each name in two folders."""
    records = corpus.in_folders(_records(spark, d))
    fresh = I.pending(records, _folder_tracker(spark, d))
    return I.merge_results(fresh, records.withColumn("extraction_method", F.lit("gemini"))).select("path", "target_table", "extraction_method")


def store_upserts(spark, d):
    """Records of a model run, then those of every third script anew, then none for every seventh; read before and after compaction."""
    root = new_path(spark, "store")
    records = _records(spark, d)
    paths = corpus.scripts(spark, d).select("path", F.regexp_extract("path", r"\d+", 0).cast("bigint").alias("k"))
    third, seventh = paths.filter("k % 3 = 0").select("path"), paths.filter("k % 7 = 0").select("path")
    store.commit(spark, root, {"lineage": store.Change(records.withColumn("extraction_method", F.lit("gemini")))})
    store.commit(spark, root, {"lineage": store.Change(records.join(third, "path", "left_semi"), third)})
    last = store.commit(spark, root, {"lineage": store.Change(records.limit(0), seventh)})
    store.compact(spark, root)
    shown = lambda seen, name: store.read_table(spark, root, "lineage", seen).select(
        F.lit(name).alias("read"), "source_file", "target_table", "extraction_method")
    return shown(last, "parts").unionByName(shown(None, "compact"))


def store_refresh(spark, d):
    """Scripts streamed into a store, then every sixth edited and the folder refreshed."""
    root, kept, state = (new_path(spark, n) for n in ("incoming", "kept", "progress"))
    corpus.write_files(corpus.scripts(spark, d), root)
    ingest.ingest_store(ingest.stream_scripts(spark, root), kept, state).awaitTermination()
    corpus.write_files(corpus.edited_scripts(spark, d), root)
    keep.refresh(spark, root, kept)
    records, _ = files.read_store(spark, kept)
    tracker = files.read_tracker(spark, kept).select("path", "status")
    return tracker.join(records.select("path", "target_table"), "path", "left").select(
        N.file_name(F.col("path")).alias("source_file"), "status", F.coalesce("target_table", F.lit("")).alias("target_table"))


def responses_file(spark, d):
    """Recorded answers written as JSON lines, read back and parsed, counted by file and method."""
    root = new_path(spark, "answers")
    corpus.answers(spark, d).select("source_file", "method", "response").write.json(root)
    parsed = A.parse_responses(files.read_responses(spark, root), ["source_file", "method"])
    return parsed.groupBy("source_file", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"))


def _count_joins(txt: str) -> dict | None:
    if "UNION" in txt:
        raise ValueError("set operation")
    return {"n_joins": txt.count(" JOIN ")} if " JOIN " in txt else None


def user_extractor(spark, d):
    """An extractor of the user's own, some of whose calls fail."""
    return M.user_stage(corpus.scripts(spark, d), _count_joins, "n_joins BIGINT").select(
        "source_file", F.coalesce("n_joins", F.lit(0)).alias("n_joins"), F.coalesce("error", F.lit("")).alias("error"))


ALL = [
    scan_scripts, scan_ddl, store_roundtrip, norm_table, strip_brackets, split_qualified, classify_expr, resolve_alias,
    clean_scripts, split_commas, split_predicates, clause_bounds, statements, primary_stmt, procedure_names, target_tables,
    source_tables, alias_map, column_mappings, column_origins, join_facts, filter_facts, grouping_facts, lineage_records, lineage_normalised, lineage_qualified,
    statement_records, complexity_signals, complexity_score, complexity_reasons, overrides_valid, overrides_merged,
    route_methods, route_counts, attempt_plan, waterfall, run_summary, failures_log, responses_parse, ddl_tables, ddl_columns,
    ddl_primary_keys, catalogue_latest, ddl_tables_found, catalogue_digest, edges, nodes, nodes_enriched, edge_merge,
    column_edges, graph_degrees, node_kinds, graph_stats, graph_export, all_tables, raw_tables, upstream, downstream,
    upstream_flow, downstream_cycles, lineage_both, lineage_tree, lineage_facts, lineage_attributes, column_incoming, column_outgoing,
    trace_inbound, trace_inbound_scripts, trace_outbound, trace_cycles, trace_tables, trace_graph, tracker_upsert, tracker_roundtrip,
    tracker_counts, pending_scripts, pending_ddl, merge_results, stream_ingest,
    pending_by_path, merge_by_path, store_upserts, store_refresh, responses_file, user_extractor,
]


def queries() -> dict:
    return {q.__name__: q for q in ALL}

"""From script and DDL tables to the stored lineage tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import snippet
from ..functions.shared import materialise
from ..operators import catalogue as K
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import records as R
from ..operators import responses as A
from ..operators import routing as M


@dataclass
class Run:
    """Tables one analysis produces."""

    records: DataFrame
    failures: DataFrame
    catalogue: DataFrame
    tracker: DataFrame


def candidates(scripts: DataFrame, answers: DataFrame | None = None, primary_only: bool = True) -> DataFrame:
    """Records of every extractor with (path, method, error): text rules, then recorded answers.

    With primary_only=False the text rules give a record per statement.
    """
    found = R.extract_lineage(scripts, primary_only).withColumnRenamed("extraction_method", "method")
    rows = found.withColumn("error", F.col("failure")).drop("failure", "stmt_no")
    if answers is None:
        return rows
    # Names repeat across folders and turns: one answer per file and method.
    parsed = A.parse_responses(answers, [c for c in answers.columns if c != "response"])
    fields = ["procedure_name", "target_table", "source_tables", "column_mappings", "joins", "filters", "grouping"]
    best = parsed.groupBy("source_file", "method").agg(F.max_by(F.struct("is_valid", *fields), F.struct("is_valid", "target_table")).alias("r"))
    named = best.select("source_file", "method", "r.*").join(scripts.select("path", "source_file"), "source_file")
    mapping = lambda m: F.struct(
        m["target_column"].alias("target_column"), m["source_table"].alias("source_table"), m["source_table"].alias("source_table_qualified"),
        m["source_column"].alias("source_column"), m["transformation_type"].alias("transformation_type"),
        m["transformation_logic"].alias("transformation_logic"), F.lit(None).cast("int").alias("insert_position"),
        F.lit(None).cast("string").alias("insert_column"))
    join = lambda j: F.struct(
        j["left_table"].alias("left_table"), j["left_table"].alias("left_table_qualified"), j["right_table"].alias("right_table"),
        j["right_table"].alias("right_table_qualified"), j["join_type"].alias("join_type"), j["condition"].alias("condition"))
    shaped = named.select(
        "path", "source_file", "procedure_name", "target_table", F.col("target_table").alias("target_table_qualified"),
        "source_tables", F.col("source_tables").alias("source_tables_qualified"),
        F.transform("column_mappings", mapping).alias("column_mappings"), F.transform("joins", join).alias("joins"),
        "filters", "grouping", "method", F.when(~F.col("is_valid"), "no valid answer").alias("error"))
    return rows.unionByName(shaped)


def analyse(scripts: DataFrame, ddl: DataFrame, tracker: DataFrame, overrides: DataFrame, prefer_model: str,
            available: list[str], processed_at: str, answers: DataFrame | None = None,
            stored: DataFrame | None = None, stored_catalogue: DataFrame | None = None,
            timestamp: Column | None = None, primary_only: bool = True) -> Run:
    """Extract what the tracker does not know yet and merge it with the stored results.

    A script gives one record, of the statement that drives lineage; with primary_only=False one per statement.
    """
    todo = I.pending(scripts, tracker, I.SCRIPT)
    new_ddl = I.pending(ddl, tracker, I.SCHEMA)
    found_tables = K.tables(new_ddl)
    catalogue = K.latest(found_tables)
    if stored_catalogue is not None:
        catalogue = K.merge(catalogue, stored_catalogue)
    # One scan for the measures and the excerpts, one for the extraction.
    scored = materialise(M.score(M.signals(todo, snippet(F.col("txt")).alias("sp_snippet"))), "scored")
    routed = M.route(M.recommend(scored, prefer_model), overrides)
    found = materialise(candidates(todo, answers, primary_only), "candidates")
    winners, failed = M.waterfall(M.attempts(routed, available), found)
    winners, failed = materialise(winners, "winners"), materialise(failed, "failed")
    won = found.filter("error is null").join(winners.select("path", "method"), ["path", "method"]).drop("error")
    records = R.normalise(won.withColumnRenamed("method", "extraction_method"))
    outcomes = I.outcomes(winners, failed, records, processed_at).unionByName(
        K.tables_found(new_ddl, found_tables).select(
            F.lit(I.SCHEMA).alias("kind"), "source_file", F.lit("success").alias("status"),
            F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("target_table"),
            "tables_found", F.lit(processed_at).alias("processed_at"), "path"))
    if stored is not None:
        records = I.merge_results(records, stored.select(*records.columns))
    return Run(records, M.failure_records(failed, scored, timestamp), catalogue, I.upsert(tracker, outcomes))


def graph_tables(records: DataFrame, catalogue: DataFrame) -> dict[str, DataFrame]:
    """The tables the graph questions read."""
    return {
        "nodes": G.enrich(G.nodes(records), catalogue), "edges": G.edges(records),
        "edge_facts": G.edge_facts(records), "column_edges": G.column_edges(records),
    }

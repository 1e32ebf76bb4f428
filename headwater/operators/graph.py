"""Table and column graph built from normalised lineage records.

Edge attributes are rows, not nested lists: one pair of tables may be loaded by a third of
all scripts, and its facts must not meet in one row or task. Every "first wins" choice is a
min_by, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import table_key
from ..sources.schemas import METHODS

CONSTANT = "(constant)"


def _seq(*more: str) -> Column:
    return F.struct("source_file", "path", *more)


def edge_rows(records: DataFrame) -> DataFrame:
    """One row per script and source table."""
    return (
        records.filter(F.coalesce("target_table", F.lit("")) != "")
        .select("path", "source_file", "procedure_name", "extraction_method", F.col("target_table").alias("dst"),
                F.explode("source_tables").alias("src"))
        .filter(F.coalesce("src", F.lit("")) != "")
    )


def edges(records: DataFrame) -> DataFrame:
    """Distinct (src, dst) with the number of scripts behind each."""
    return edge_rows(records).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_scripts"))


def edge_facts(records: DataFrame) -> DataFrame:
    """Distinct facts per edge: mappings, joins, filters, grouping, procedures and methods.

    k1..k4 are the identity of a fact of that kind; `detail` is kept from the first script.
    """
    rows = records.filter(F.coalesce("target_table", F.lit("")) != "").select(
        "path", "source_file", F.col("target_table").alias("dst"),
        F.explode(F.filter("source_tables", lambda s: F.coalesce(s, F.lit("")) != "")).alias("src"),
        "column_mappings", "joins", "filters", "grouping", "procedure_name", "extraction_method")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fact = lambda kind, a=None, b=None, c=None, d=None, detail=None: F.struct(
        F.lit(kind).alias("kind"), *[text(F.lit("") if x is None else x).alias(f"k{i}") for i, x in enumerate((a, b, c, d), 1)],
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    facts = F.concat(
        F.transform("column_mappings", lambda m: fact(
            "mapping", m["target_column"], m["source_table"], m["source_column"],
            detail=F.to_json(F.struct(m["transformation_type"], m["transformation_logic"])))),
        F.transform("joins", lambda j: fact("join", j["left_table"], j["right_table"], j["join_type"], j["condition"])),
        F.transform("filters", lambda x: fact("filter", x)),
        F.transform("grouping", lambda x: fact("grouping", x)),
        F.filter(F.array(fact("procedure", F.col("procedure_name")), fact("method", F.col("extraction_method"))),
                 lambda x: x["k1"] != ""),
    )
    rows = rows.select("path", "source_file", "src", "dst", F.posexplode_outer(facts).alias("no", "f")).select(
        "path", "source_file", "src", "dst", "no", "f.*").filter("kind is not null")
    return rows.groupBy("src", "dst", "kind", "k1", "k2", "k3", "k4").agg(
        F.min_by("detail", _seq("no")).alias("detail"))


def edge_merge(records: DataFrame) -> DataFrame:
    """Number of distinct facts of each kind per edge."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return edge_facts(records).groupBy("src", "dst").agg(
        n("mapping").alias("n_mappings"), n("join").alias("n_joins"), n("filter").alias("n_filters"),
        n("grouping").alias("n_grouping"), n("procedure").alias("n_procedures"), n("method").alias("n_methods"))


def nodes(records: DataFrame) -> DataFrame:
    """Distinct tables; the display name is the longest name found, the first one on ties."""
    named = F.array(F.struct(F.col("target_table").alias("id"), F.col("target_table_qualified").alias("raw")))
    used = F.transform(F.arrays_zip("source_tables", "source_tables_qualified"), lambda z: F.struct(
        z["source_tables"].alias("id"), z["source_tables_qualified"].alias("raw")))
    rows = records.filter(F.coalesce("target_table", F.lit("")) != "").select(
        "path", "source_file", F.posexplode_outer(F.concat(named, used)).alias("no", "n"))
    rows = rows.select("path", "source_file", "no", "n.id", "n.raw").filter(F.coalesce("id", F.lit("")) != "")
    return rows.groupBy("id").agg(
        F.min_by("raw", F.struct((-F.length("raw")).alias("l"), "source_file", "path", "no")).alias("display_name"))


def enrich(node_rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Attach catalogue attributes; tables not in it get the defaults."""
    cat = catalogue.select(
        F.col("table_name").alias("id"), "qualified_name", "database", "schema", "columns", F.lit(True).alias("found"))
    return node_rows.join(cat, "id", "left").select(
        "id", "display_name",
        F.coalesce("schema", F.when(F.col("found"), "").otherwise("dbo")).alias("schema"),
        F.coalesce("database", F.lit("")).alias("database"),
        F.coalesce("qualified_name", F.lit("")).alias("qualified_name"),
        F.coalesce(F.transform("columns", lambda c: c["name"]), F.array().cast("array<string>")).alias("columns"),
        F.col("columns").alias("column_details"),
        F.coalesce("found", F.lit(False)).alias("in_catalogue"))


def degrees(edge_table: DataFrame) -> DataFrame:
    ends = edge_table.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def node_kinds(node_rows: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Degrees of every node; source-only and target-only tables are marked."""
    rows = node_rows.select("id").join(degrees(edge_table), "id", "left").na.fill(0)
    return rows.withColumn("kind", F.when((F.col("in_degree") == 0) & (F.col("out_degree") > 0), "source").when(
        (F.col("in_degree") > 0) & (F.col("out_degree") == 0), "target").otherwise("neither"))


def statistics(records: DataFrame, failures: DataFrame) -> DataFrame:
    """(metric, value): totals, source and target tables, procedures, edges per method, failures."""
    e = edges(records)
    kinds = node_kinds(nodes(records), e).agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if(F.col("kind") == "source").alias("source_tables"),
        F.count_if(F.col("kind") == "target").alias("target_tables"))
    by_edge = edge_rows(records)
    per = by_edge.groupBy("src", "dst").agg(*[
        F.max((F.col("extraction_method") == m).cast("int")).alias(m) for m in METHODS])
    totals = per.agg(F.count(F.lit(1)).alias("total_edges"), *[F.sum(m).alias(f"edges_{m}") for m in METHODS])
    procs = by_edge.filter(F.coalesce("procedure_name", F.lit("")) != "").agg(F.count_distinct("procedure_name").alias("procedures"))
    failed = failures.agg(F.count(F.lit(1)).alias("failed"))
    long = lambda df: df.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in df.columns]),
        F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in df.columns]))).alias("metric", "value"))
    return long(kinds).unionByName(long(totals)).unionByName(long(procs)).unionByName(long(failed))


def column_edges(records: DataFrame) -> DataFrame:
    """(src_table, src_col) -> (dst_table, dst_col); a constant reads from `(constant)`.

    A mapping without a source table counts for every source table of its script.
    """
    rows = records.filter(F.coalesce("target_table", F.lit("")) != "").select(
        "path", "source_file", "target_table", "source_tables", F.posexplode("column_mappings").alias("no", "m"))
    named = F.coalesce(table_key(F.col("m.source_table")), F.lit(""))
    reads = F.when(F.col("m.transformation_type") == "constant", F.array(F.lit(CONSTANT))).when(
        named != "", F.array(named)).otherwise(F.col("source_tables"))
    rows = rows.select("path", "source_file", "no", F.explode(reads).alias("src_table"), F.col("m.source_column").alias("src_col"),
                       F.col("target_table").alias("dst_table"), F.col("m.target_column").alias("dst_col"),
                       F.struct(F.col("m.transformation_type").alias("type"), F.col("m.transformation_logic").alias("logic")).alias("how"))
    return rows.groupBy("src_table", "src_col", "dst_table", "dst_col").agg(
        F.min_by("how", _seq("no")).alias("how")).select(
        "src_table", "src_col", "dst_table", "dst_col", "how.type", "how.logic")


def raw_tables(enriched: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Tables nothing feeds, or whose name says raw."""
    rows = enriched.join(degrees(edge_table).select("id", "in_degree"), "id", "left")
    says_raw = F.lower("display_name").contains("raw") | F.lower("qualified_name").contains("raw")
    return rows.filter((F.coalesce("in_degree", F.lit(0)) == 0) | says_raw).select("id")


def column_incoming(col_edges: DataFrame, tables: DataFrame) -> DataFrame:
    """One hop into each table of `tables(id)`."""
    return col_edges.join(tables.select(F.col("id").alias("dst_table")).distinct(), "dst_table", "left_semi")


def column_outgoing(records: DataFrame, tables: DataFrame) -> DataFrame:
    """All mappings on edges out of each table; `is_own` marks those that read the table itself."""
    rows = records.filter(F.coalesce("target_table", F.lit("")) != "").select(
        "path", "source_file", F.col("target_table").alias("dst_table"), F.explode("source_tables").alias("id"), "column_mappings")
    rows = rows.join(tables.select("id").distinct(), "id", "left_semi")
    rows = rows.select("path", "source_file", "id", "dst_table", F.posexplode("column_mappings").alias("no", "m"))
    named = F.coalesce(table_key(F.col("m.source_table")), F.lit(""))
    return rows.groupBy(
        "id", "dst_table", named.alias("src_table"), F.col("m.source_column").alias("src_col"),
        F.col("m.target_column").alias("dst_col"),
    ).agg(F.min_by("m.transformation_type", _seq("no")).alias("type")).withColumn(
        "is_own", (F.col("src_table") == F.col("id")) | (F.col("src_table") == ""))


def export_lines(enriched: DataFrame, edge_table: DataFrame, facts: DataFrame) -> DataFrame:
    """Node-link JSON as lines: nodes, edges, and one line per edge fact."""
    label = F.coalesce(F.nullif("qualified_name", F.lit("")), F.nullif("display_name", F.lit("")), F.col("id"))
    node = F.struct("id", label.alias("label"), "display_name", "qualified_name", "database", "schema", "columns",
                    "column_details", "in_catalogue")
    ends = [F.col("src").alias("source"), F.col("dst").alias("target")]
    line = lambda df, kind, body: df.select(F.lit(kind).alias("kind"), F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))
    return line(enriched, "node", node).unionByName(line(edge_table, "edge", F.struct(*ends, "n_scripts"))).unionByName(
        line(facts, "edge_fact", F.struct(*ends, "kind", "k1", "k2", "k3", "k4", "detail")))


def run_summary(records: DataFrame, failures: DataFrame) -> DataFrame:
    """Records per extraction method, and failures."""
    done = records.groupBy(F.col("extraction_method").alias("method")).agg(F.count(F.lit(1)).alias("n"))
    return done.unionByName(failures.agg(F.count(F.lit(1)).alias("n")).select(F.lit("failed").alias("method"), "n"))

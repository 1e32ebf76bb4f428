"""Reach of tables along edges, for many starting tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import table_key
from ..functions.shared import materialise
from ..functions.skew import hot_keys, salted_join


def _reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str, hot_rows: int, tables: DataFrame | None) -> DataFrame:
    """(seed, node, hop, via): nodes within `depth` hops; `via` is the smallest neighbour that led there.

    Seeds are tables of an edge or of `tables(id)`, so that one without edges reaches itself; others reach nothing.
    """
    if depth < 0 or direction not in ("upstream", "downstream"):
        raise ValueError("depth must not be negative; direction is upstream or downstream")
    near, far = ("dst", "src") if direction == "upstream" else ("src", "dst")
    step = edges.filter("src <> dst").select(F.col(near).alias("at"), F.col(far).alias("node")).distinct()
    known = edges.select(F.explode(F.array("src", "dst")).alias("seed")).distinct()
    if tables is not None:
        known = known.unionByName(tables.select(F.col("id").alias("seed"))).distinct()
    starts = seeds.select(table_key(F.col("seed")).alias("seed")).distinct().join(known, "seed", "left_semi")
    step = materialise(step, "steps")
    hot = hot_keys(step, ["at"], min_rows=hot_rows)
    found = materialise(starts.select(
        "seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")), "hop0")
    frontier = found
    for hop in range(1, depth + 1):
        reached = salted_join(frontier.select("seed", F.col("node").alias("at")), step, ["at"], hot)
        new = (
            reached.groupBy("seed", "node").agg(F.min("at").alias("via"))
            .join(found.select("seed", "node"), ["seed", "node"], "left_anti")
            .select("seed", "node", F.lit(hop).alias("hop"), "via")
        )
        frontier = materialise(new, f"hop{hop}")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def upstream(edges: DataFrame, seeds: DataFrame, depth: int = 5, hot_rows: int = 100_000, tables: DataFrame | None = None) -> DataFrame:
    return _reach(edges, seeds, depth, "upstream", hot_rows, tables)


def downstream(edges: DataFrame, seeds: DataFrame, depth: int = 5, hot_rows: int = 100_000, tables: DataFrame | None = None) -> DataFrame:
    return _reach(edges, seeds, depth, "downstream", hot_rows, tables)


def _at_lesser_end(step: DataFrame, hot_rows: int) -> DataFrame:
    """(at, other, forward): each edge once, at the end where fewer edges go the same way.

    A table of many edges then holds none that a table of few can name, and no table more than about the square root of all.
    """
    n = lambda end: step.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}"))
    rows = step
    for end in ("src", "dst"):
        rows = salted_join(n(end), rows, [end], hot_keys(step, [end], min_rows=hot_rows))
    forward = F.col("n_src") <= F.col("n_dst")
    return rows.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("at"),
                       F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("other"), forward.alias("forward"))


def reach_edges(edges: DataFrame, reach: DataFrame, direction: str, edges_kept: str = "induced", hot_rows: int = 100_000) -> DataFrame:
    """Edges of a reach: all between its nodes, or only the discovery edge of each node ("tree").

    An edge is looked up from the end of fewer edges, so that a table which feeds many others is not met with all of them
    for each seed that it feeds. The edges of a table that holds a large share of them are spread over tasks.
    """
    if edges_kept == "tree":
        src, dst = ("node", "via") if direction == "upstream" else ("via", "node")
        return reach.filter("hop > 0").select("seed", F.col(src).alias("src"), F.col(dst).alias("dst"))
    step = materialise(edges.filter("src <> dst").select("src", "dst").distinct(), "steps")
    ends = materialise(_at_lesser_end(step, hot_rows), "steps")
    pairs = salted_join(reach.select("seed", F.col("node").alias("at")), ends, ["at"], hot_keys(ends, ["at"], min_rows=hot_rows))
    both = pairs.join(reach.select("seed", F.col("node").alias("other")), ["seed", "other"])
    return both.select("seed", F.when(F.col("forward"), F.col("at")).otherwise(F.col("other")).alias("src"),
                       F.when(F.col("forward"), F.col("other")).otherwise(F.col("at")).alias("dst"))


def lineage(edges: DataFrame, seeds: DataFrame, depth: int = 5, edges_kept: str = "induced", hot_rows: int = 100_000,
            tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (seed, node, hop; upstream hops are negative) and edges in both directions."""
    up, down = upstream(edges, seeds, depth, hot_rows, tables), downstream(edges, seeds, depth, hot_rows, tables)
    nodes = (
        up.select("seed", "node", (-F.col("hop")).alias("hop"))
        .unionByName(down.select("seed", "node", "hop"))
        .groupBy("seed", "node").agg(F.min_by("hop", F.struct(F.abs("hop"), "hop")).alias("hop"))
    )
    both = reach_edges(edges, up, "upstream", edges_kept, hot_rows).unionByName(
        reach_edges(edges, down, "downstream", edges_kept, hot_rows)).distinct()
    return nodes, both


def with_attributes(nodes: DataFrame, node_table: DataFrame) -> DataFrame:
    """Attach node attributes to a reach."""
    return nodes.join(node_table.withColumnRenamed("id", "node"), "node")


def with_facts(reached: DataFrame, facts: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """Attach to each edge of a reach (seed, src, dst) its facts, one row each; edges without facts give no rows.

    Edges with a large share of all facts are spread over tasks.
    """
    return salted_join(reached, facts, ["src", "dst"], hot_keys(facts, ["src", "dst"], min_rows=hot_rows))

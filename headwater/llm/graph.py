"""Connected components of a table of links. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise


def _down(pairs: DataFrame) -> DataFrame:
    """Links as rows (u, v) with v below u, each once."""
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: each component is a star then."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("over"), F.lit(0).alias("under")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    ends = ends.groupBy("node").agg(F.sum("over").alias("over"), F.sum("under").alias("under"))
    return ends.filter((F.col("over") > 1) | ((F.col("over") > 0) & (F.col("under") > 0))).isEmpty()


def _large(pairs: DataFrame) -> DataFrame:
    """Large-star step: every node hands its larger neighbours to the smallest node it knows."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("of"), F.least("u", "w").alias("w"))
    return _down(both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("w").alias("v")))


def _small(pairs: DataFrame) -> DataFrame:
    """Small-star step: every node hands its smaller neighbours to the smallest of them."""
    floor = pairs.groupBy("u").agg(F.min("v").alias("w"))
    return _down(pairs.join(floor, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(floor.select("u", F.col("w").alias("v"))))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every linked node; a component is named by its smallest node.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller
    neighbours to the smallest node it knows, until all components are stars; a logarithmic number of
    rounds in practice. Minima are pre-aggregated, so a node with very many links is no single group. Every step is
    written to the shared folder: its plan stays a few joins, which the driver holds, and a lost executor costs one step.
    """
    pairs = materialise(_down(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    while not _settled(pairs):
        pairs = materialise(_small(materialise(_large(pairs), "links")), "links")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: A table of at most so many rows of a key and a node may be sent to every task (about 7 MB as it was measured, 34 MB for 500,000).
SMALL_ROWS = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """A written table with the broadcast hint where its counted rows are few; else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def shared_posts(keys: DataFrame, name: str, attrs: DataFrame | None = None) -> DataFrame:
    """Rows (key, node, attr, lo) of the index keys that two nodes or more have; lo is a key's smallest node.

    Keys are shuffled once; most of them have one node and are dropped where they arrive. Attributes given as rows
    (node, attr) are joined to those that stay.
    """
    own = Window.partitionBy("key")
    ends = keys.withColumn("lo", F.min("node").over(own)).withColumn("hi", F.max("node").over(own)).filter("lo <> hi")
    ends = ends.drop("hi").distinct()
    return materialise(ends if attrs is None else ends.join(attrs, "node"), f"{name}-posts")


def linked(posts: DataFrame, near: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Components (node, component) over the verified links of nodes that share a key.

    First every node of a key is compared with the key's smallest node. What links becomes a
    component. Then all pairs of a key that lie in different components yet are compared. No link
    between components is missed, and a group of copies costs one comparison per node, not all
    pairs. `near` is a cheap necessary condition on the attributes of two nodes; `verify` keeps the
    true links of a table (a, b).
    """
    smallest = posts.filter("node = lo").select("key", F.col("attr").alias("lo_attr")).distinct()
    star = posts.filter("node <> lo").join(smallest, "key").filter(near(F.col("attr"), F.col("lo_attr")))
    tried = materialise(star.select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), f"{name}-star")
    links = materialise(verify(tried), f"{name}-links")
    found = components(links)
    own = posts.join(found, "node", "left").select("key", "node", "attr", F.coalesce("component", "node").alias("component"))
    own = materialise(own, f"{name}-own")
    mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    own = own.join(mixed, "key", "left_semi")
    other = own.select("key", F.col("node").alias("b"), F.col("attr").alias("b_attr"), F.col("component").alias("b_component"))
    rest = own.join(other, "key").filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("b_component")) & near(F.col("attr"), F.col("b_attr")))
    rest = rest.select(F.col("node").alias("a"), "b").distinct().join(tried, ["a", "b"], "left_anti")
    return components(links.unionByName(verify(materialise(rest, f"{name}-rest"))))

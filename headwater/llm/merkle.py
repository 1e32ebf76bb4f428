"""Merkle manifest of a dataset: streamed aligned blocks, partial witnesses extended as siblings complete.

Leaves of a tree lie in runs of `fanout`; blocks are aligned and hold a power of `fanout` of them. One
appender closes a block's runs while its leaves stream in; the block's root is then an append of the next
round, until each tree is one node. Witnesses go the way back: a block gives each of its nodes the steps
inside the block, then the steps that the block's own root was given.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise
from .common import ids_of, remainder_column

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "at int, siblings string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value with its length in front, so that no two rows give the same text; `-` where it is missing."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


class Appender:
    """Open runs of a growing tree, level by level.

    Each open subtree carries the partial witnesses of the appended nodes under it. When a run
    closes, each witness under one of its nodes is extended by the others of the run.
    """

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.open: list[list] = [[]]
        self.witnesses: list[list] = []

    def append(self, node: str) -> None:
        witness: list = []
        self.witnesses.append(witness)
        self._add(0, node, [witness])

    def _add(self, level: int, node: str, below: list) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == self.fanout:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for at, (_, below) in enumerate(run):
            step = (at, "".join(nodes[:at] + nodes[at + 1:]))
            for witness in below:
                witness.append(step)
        self._add(level + 1, digest("".join(nodes)), [w for _, below in run for w in below])

    def finish(self, height: int | None) -> str:
        """The one node left: at `height`, or, without a height, where only one is left."""
        level = 0
        while True:
            run = self.open[level]
            last = not any(self.open[level + 1:])
            if len(run) == 1 and last and (height is None or level == height):
                return run[0][0]
            if run:
                self._close(level)
            level += 1


def fold(node: str, steps) -> str:
    """The root that a leaf and its witness give; a step's siblings stand around the node."""
    for at, siblings in steps:
        cut = at * 64
        node = digest(siblings[:cut] + node + siblings[cut:])
    return node


def _appended(nodes, alone: bool, fanout: int, height: int) -> tuple[str, list]:
    appender = Appender(fanout)
    for node in nodes:
        appender.append(node)
    return appender.finish(None if alone else height), appender.witnesses


def _blocks(nodes: DataFrame, fanout: int, height: int, *carry: str) -> DataFrame:
    """Rows (tree, block, total, nodes, root) of aligned blocks; a block is a bounded group of fanout ** height nodes."""
    span = fanout ** height
    kept = F.struct("pos", "node", *carry)
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / span).alias("block")).agg(
        F.array_sort(F.collect_list(kept)).alias("nodes"), F.max("total").alias("total"))

    @F.pandas_udf("string")
    def root(each: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([_appended(list(x), n <= span, fanout, height)[0] for x, n in zip(each, total)], dtype=object)

    return rows.select("tree", "block", "total", "nodes", root(F.col("nodes.node"), F.col("total")).alias("root"))


def grow(nodes: DataFrame, fanout: int, height: int, *carry: str) -> list[DataFrame]:
    """Rounds of blocks over rows (tree, pos, total, node), until every tree is one block; each round is written."""
    span = fanout ** height
    rounds = [materialise(_blocks(nodes, fanout, height, *carry), "merkle")]
    while not rounds[-1].filter("block > 0").isEmpty():
        up = rounds[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / span).alias("total"), F.col("root").alias("node"))
        rounds.append(materialise(_blocks(up, fanout, height), "merkle"))
    return rounds


def _extended(blocks: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """Rows (tree, pos, steps) of every node of the blocks: its steps inside, then those of its block in `above`."""
    span = fanout ** height

    def extend(batches):
        for batch in batches:
            for tree, block, total, nodes, steps in batch.itertuples(index=False):
                _, inner = _appended(list(nodes), total <= span, fanout, height)
                outer = [(s["at"], s["siblings"]) for s in steps]
                yield pd.DataFrame({"tree": tree, "pos": range(block * span, block * span + len(inner)),
                                    "steps": [[{"at": at, "siblings": s} for at, s in w + outer] for w in inner]})

    return blocks.select("tree", "block", "total", F.col("nodes.node").alias("nodes")).join(above, ["tree", "block"]).select(
        "tree", "block", "total", "nodes", "steps").mapInPandas(extend, f"tree bigint, pos bigint, steps array<struct<{_STEP}>>")


def _handed_down(rounds: list[DataFrame], above: DataFrame, fanout: int, height: int) -> DataFrame:
    """`above` has the steps of each tree's last node; rows (tree, block, steps) of the first round's blocks."""
    for blocks in reversed(rounds[1:]):
        above = materialise(_extended(blocks, above, fanout, height).withColumnRenamed("pos", "block"), "merkle-steps")
    return above


def placed(docs: DataFrame, by: str, order: str, leaf_of: Column, *more: Column) -> tuple[DataFrame, DataFrame]:
    """Leaves at their places in their trees: (tree, pos, total, node, key, more...), and the trees (tree, by).

    One range shuffle sorts leaves by tree and key; places come from the counts of the ranges, a row for each
    range and tree. Equal keys go by leaf; rows alike in both are alike, and take places in reading order.
    """
    rows = docs.select(F.col(by).cast("string").alias("by"), F.col(order).cast("bigint").alias("key"), leaf_of.alias("node"), *more)
    rows = rows.withColumn("turn", F.monotonically_increasing_id())
    sort = [F.asc_nulls_first("by"), F.asc_nulls_first("key"), F.asc("node"), F.asc("turn")]
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("turn").select(
        "*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("line"))
    rows = materialise(rows, "merkle-leaves")
    counts = rows.groupBy("by", "range").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    whole = Window.partitionBy("by")
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("by", "range", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(whole).alias("total"))
    trees = materialise(rows.groupBy("by").agg(F.count(F.lit(1)).alias("n")).select(
        (F.row_number().over(Window.orderBy(F.asc_nulls_first("by"))) - 1).cast("bigint").alias("tree"), "by"), "merkle-trees")
    starts = counts.join(trees.withColumnRenamed("by", "_by"), F.col("by").eqNullSafe(F.col("_by"))).drop("_by")
    starts = starts.withColumnRenamed("by", "_by").withColumnRenamed("range", "_range")
    found = rows.join(starts, F.col("by").eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_range")))
    return found.withColumn("pos", F.col("before") + F.col("line") - F.col("first")).drop(
        "by", "_by", "range", "_range", "line", "first", "before"), trees


def manifest(docs: DataFrame, fields: tuple = FIELDS, by: str = "lang", order: str = "doc_id", lowered: str = "text",
             folds: int = 3, fanout: int = 8, height: int = 3) -> DataFrame:
    """A row per document: key, leaf, subroot of its tree, root, its witness as steps, and the leaf a tampered copy gives.

    A tree holds the documents of one value of `by`, ascending in `order`; the trees' roots, ordered by that
    value, are the leaves of the last tree. A step is a place in a run and the run's other nodes, in order.
    The tampered copy has A-Z of the column `lowered` in lower case where the key's crc32 is a multiple of `folds`;
    else `tampered` is null. Equal rows are leaves of their own; a missing value is `-`; a missing `by` is a tree of its own,
    the first; missing keys come first in their tree and are not tampered with; no rows give no rows; other columns count for nothing.
    """
    lower = F.translate(F.col(lowered).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    edited = leaf([lower if c == lowered else F.col(c) for c in fields])
    hit = F.col(order).isNotNull() & (remainder_column(F.col(order).cast("bigint"), folds) == 0)
    leaves, trees = placed(docs, by, order, leaf([F.col(c) for c in fields]), F.when(hit, edited).alias("tampered"))
    rounds = grow(leaves, fanout, height, "key", "tampered")
    subroots = rounds[-1].select("tree", "root")
    last = grow(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"),
                                F.lit(trees.count()).alias("total"), F.col("root").alias("node")), fanout, height)
    start = last[-1].select("tree", "block", F.expr(f"cast(array() as array<struct<{_STEP}>>)").alias("steps"))
    of_trees = _extended(last[0], _handed_down(last, start, fanout, height), fanout, height)
    above = of_trees.select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("block"), "steps")
    above = _handed_down(rounds, materialise(above, "merkle-steps"), fanout, height)
    root = last[-1].select("root").first()
    ends = subroots.select("tree", F.col("root").alias("subroot"), F.lit(root and root["root"]).cast("string").alias("root"))
    return _witnessed(rounds[0], above.join(ends, "tree"), fanout, height)


def _witnessed(blocks: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    span = fanout ** height

    def give(batches):
        for batch in batches:
            for nodes, keys, tampered, total, steps, subroot, root in batch.itertuples(index=False):
                _, inner = _appended(list(nodes), total <= span, fanout, height)
                outer = [(s["at"], s["siblings"]) for s in steps]
                keys = pd.array(ids_of(pd.Series(keys, dtype=object)), dtype="Int64")
                yield pd.DataFrame({"key": keys, "leaf": list(nodes), "tampered": list(tampered), "subroot": subroot, "root": root,
                                    "steps": [[{"at": at, "siblings": s} for at, s in w + outer] for w in inner]})

    rows = blocks.select("tree", "block", "total", "nodes").join(above, ["tree", "block"])
    return rows.select("nodes.node", "nodes.key", "nodes.tampered", "total", "steps", "subroot", "root").mapInPandas(
        give, f"key bigint, leaf string, tampered string, subroot string, root string, steps array<struct<{_STEP}>>")


def verified(rows: DataFrame) -> DataFrame:
    """`manifest`'s rows with proof_sha256, and folded_root and verified of the tampered, else the original leaf."""

    def check(batches):
        for batch in batches:
            steps = [[(s["at"], s["siblings"]) for s in x] for x in batch["steps"]]
            shown = batch["tampered"].where(batch["tampered"].notna(), batch["leaf"])
            batch["proof_sha256"] = [digest("".join(s for _, s in x)) for x in steps]
            batch["folded_root"] = [fold(node, x) for node, x in zip(shown, steps)]
            batch["verified"] = batch["folded_root"] == batch["root"]
            batch["key"] = pd.array(ids_of(batch["key"]), dtype="Int64")
            yield batch[["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    return rows.mapInPandas(check, "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import materialise
from .common import WORD

_ROW = ["doc_id", "mark", "copy_no"]


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    """Source, size and shuffle key of every row; rows alike in id and text are numbered."""
    text = F.col("text").cast("string")
    alike = Window.partitionBy("doc_id", "mark").orderBy("source")
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("mark"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"), *more,
    ).withColumn("copy_no", F.row_number().over(alike))


def targets(rows: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """Words each source is to give: by weight, none above `most` times its size.

    Sources in order of size per weight: those whose bound is below the level that the rest
    would share are full; the others share what is left by weight. One row per source.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = total.select("source", "source_size", rank.alias("source_no"), weight.alias("weight")).withColumn(
        "bound", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("bound") / F.col("weight"), "source_no")
    spent = F.coalesce(F.sum("bound").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("budget", budget).withColumn("level", (F.col("budget") - spent) / left)
    is_full = F.col("bound") / F.col("weight") <= F.col("level")
    level = F.min(F.when(~is_full, F.struct(F.col("bound") / F.col("weight"), "source_no", "level"))).over(Window.partitionBy())["level"]
    return rows.select("source", "source_no", "source_size", "budget",
                       F.when(is_full, F.col("bound")).otherwise(level * F.col("weight")).alias("target"))


def taken(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0,
          rows_per_bucket: int = 50_000) -> DataFrame:
    """What the mix takes of every row: size, source_size, target and taken, in words.

    Rows of a source queue in the order of md5(doc_id), the whole queue `most` times over. A
    row's virtual finish time is the number of the source's words up to its end, over the
    source's target. All rows of all sources are range-sorted by finish time and taken while
    their running sum of words stays within `share` times all words.

    Running sums are two-level: sums of buckets first, then within a bucket, so a source that
    holds most rows is spread over tasks. Buckets are prefixes of the key and change no result.
    Missing text has size 0, a missing source is a source of its own and the last, repeated rows
    queue one after the other, rows of size 0 are never taken, no rows yield no rows.
    """
    rows = materialise(_rows(docs), "mix-rows")
    sources = materialise(targets(rows, weights, share, most), "mix-sources")
    digits = max(2, math.ceil(math.log(max(1, rows.count() / rows_per_bucket), 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits)).join(
        sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    line = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size", "mark", "copy_no")
    queued = rows.join(sums, ["source_no", "bucket"]).withColumn(
        "upto", F.col("before") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passes = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)))).withColumn(
        "finish", F.try_divide((F.col("upto") + F.col("turn") * F.col("source_size")).cast("double"), F.col("target")))
    order = ["finish", "source_no", "key", "doc_id", "size", "mark", "copy_no", "turn"]
    ranged = materialise(passes.select(*order, "source_size", "target", "budget").repartitionByRange(*order).withColumn(
        "part", F.spark_partition_id()), "mix-order")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("n")).select("part", F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ranged.withColumn("running", F.sum("size").over(within)).join(parts, "part")
    fits = F.col("before") + F.col("running") <= F.col("budget")
    return cut.groupBy(*_ROW, "size", "source_size", "target").agg(
        F.sum(F.when(fits & F.col("finish").isNotNull(), F.col("size")).otherwise(0)).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as `taken` says (not at all, once or more)."""
    kept = taken(docs, **options).filter("taken > 0").select(*_ROW, (F.col("taken") / F.col("size")).cast("int").alias("times"))
    kept = kept.select(*[F.col(c).alias(f"_{c}") for c in _ROW], "times")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    return _rows(whole, "row").join(
        kept, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("mark").eqNullSafe(F.col("_mark")) & (F.col("copy_no") == F.col("_copy_no"))
    ).select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")

"""Lineage records from recorded model answers, which wrap JSON in prose and fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import drop_brackets
from ..sources.schemas import ANSWER
from .tokens import running

_PIECE = r'"(?:[^"\\]++|(?s:\\.))*+"|[{}]|[^"{}]++|"'


def json_objects(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): the first balanced block of each answer that is valid JSON.

    Where an answer has a fence line that opens a block, the answer is read from the line after it;
    fences of any language tag are known, and marks inside a JSON string open nothing. Braces inside
    strings do not count. Braces are matched by level with a window over the pieces of one answer.
    """
    parts = F.split(F.trim(F.col("response")), r"(?m)^[ \t]*```[^\n`]*$", 2)
    body = F.when((F.size(parts) > 1) & ~F.contains(parts[0], F.lit("{")), parts[1]).otherwise(F.trim(F.col("response")))
    rows = responses.select(*keys, body.alias("body")).withColumn(
        "body", F.expr("substring(body, instr(body, '{'))")).filter(F.col("body").startswith("{"))
    pieces = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).select(
        *keys, "body", F.posexplode_outer(F.regexp_extract_all("body", F.lit(_PIECE), F.lit(0))).alias("pos", "p"))
    step = F.when(F.col("p") == "{", 1).when(F.col("p") == "}", -1).otherwise(0)
    pieces = pieces.select(
        *keys, "body", "pos", "p",
        F.sum(F.length("p")).over(running(keys)).alias("stop"),
        (F.sum(step).over(running(keys)) + F.when(F.col("p") == "}", 1).otherwise(0)).alias("level"))
    braces = pieces.filter(F.col("p").isin("{", "}"))
    w = Window.partitionBy(*keys, "level").orderBy("pos")
    braces = braces.select("*", F.lead("p").over(w).alias("next_p"), F.lead("stop").over(w).alias("end"))
    blocks = braces.filter("p = '{' and next_p = '}'").select(
        *keys, F.col("stop").alias("start"), F.expr("substring(body, stop, end - stop + 1)").alias("json"))
    valid = blocks.filter(F.try_parse_json("json").isNotNull())
    return valid.groupBy(*keys).agg(F.min(F.struct("start", "json")).alias("b")).select(*keys, "b.json")


def _without_brackets(rows: DataFrame) -> DataFrame:
    """Drop brackets from every identifier and text of the records, and null list items."""
    texts = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), drop_brackets)
    structs = lambda c, fields: F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.struct(
        *[(x[f] if f in ("transformation_type", "join_type") else drop_brackets(x[f])).alias(f) for f in fields]))
    return rows.withColumns({
        "procedure_name": drop_brackets(F.col("procedure_name")), "target_table": drop_brackets(F.col("target_table")),
        **{c: texts(F.col(c)) for c in ("source_tables", "filters", "grouping")},
        "column_mappings": structs(F.col("column_mappings"), [
            "target_column", "source_table", "source_column", "transformation_type", "transformation_logic"]),
        "joins": structs(F.col("joins"), ["left_table", "right_table", "join_type", "condition"]),
    })


def parse_responses(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per answer: record fields (null when there is no valid object) and `is_valid`."""
    keys = keys or ["source_file", "method"]
    # Answers that share their keys are told apart by their text.
    rows = responses.select(*keys, "response", F.xxhash64("response").alias("_text"))
    own = [*keys, "_text"]
    found = json_objects(rows.dropDuplicates(own), own).withColumn("r", F.from_json("json", ANSWER))
    found = _without_brackets(found.select(*own, "r.*"))
    return rows.select(*own).hint("merge").join(found, own, "left").drop("_text").withColumn(
        "is_valid", F.coalesce(F.col("target_table") != "", F.lit(False)))

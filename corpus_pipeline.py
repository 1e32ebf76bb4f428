"""A training corpus from raw documents: filter, dedup lines, dedup documents, mix, pack.

Each stage takes the documents its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.functions.shared import materialise
from headwater.llm import lines, mixing, packing, quality, setjoin
from headwater.llm.common import table
from headwater.llm.queries import word_vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document or line has."""
    return lines.without_repeats(docs, weighted=True).select(docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8."""
    return setjoin.one_of_each(docs, n=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of 4096."""
    return packing.pack(docs, word_vocabulary())


STAGES = [("quality", good), ("lines", fresh_lines), ("near-duplicates", one_per_group), ("mix", mixed), ("pack", packed)]

#: Line dedup finds near lines by blocks of a SimHash and the classifier is trained: SQL cannot state their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

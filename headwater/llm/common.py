"""Small helpers of the training-data operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator and contract here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text column, a missing text counting as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def remainder(doc_id, divisor: int) -> int:
    """crc32 of an id written as text, modulo `divisor`; a missing id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor


def remainder_column(doc_id: Column, divisor: int) -> Column:
    """`remainder` as a column expression."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def ids_of(column) -> list:
    """A pandas column of nullable longs as Python ints and None."""
    return [None if x is None or x != x else int(x) for x in column.tolist()]


def numbered(docs: DataFrame) -> DataFrame:
    """(row_no, whole): the rows as one struct each, so that no name of theirs meets an operator's own."""
    fields = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.monotonically_increasing_id().alias("row_no"), F.struct(*fields).alias("whole"))

"""Materialise intermediate tables where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own; on a cluster a
    missing setting is an error, since a machine-local folder dies with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="headwater-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` once and read it back: cuts the plan and survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def kept(make: Callable) -> Callable:
    """For a function without arguments that gives expressions over columns by name: they are made once in a JVM.

    Large expressions take thousands of calls to the JVM, which a stream would repeat for each batch.
    """
    made: dict = {}

    @wraps(make)
    def get():
        jvm = SparkContext._jvm
        if made.get("jvm") is not jvm:
            made.update(jvm=jvm, value=make())
        return made["value"]

    return get

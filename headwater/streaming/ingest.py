"""Continuous ingest: new script files become lineage records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import extract_lineage
from ..plans.keep import save_scripts
from ..sources.files import _shaped


#: Most tasks that look up the files of a batch; Spark itself starts one for each file.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listing_session(spark: SparkSession) -> SparkSession:
    """A copy of the session whose tasks look up many files each: a batch names its files one by one."""
    most = min(int(spark.conf.get(LISTING)), 4 * spark.sparkContext.defaultParallelism)
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(LISTING, str(most))
    return own


def stream_scripts(spark: SparkSession, root: str, files_per_batch: int = 10_000) -> DataFrame:
    """File stream of *.sql below `root`; the checkpoint remembers what was read.

    It runs in a copy of the session, with its settings of now.
    """
    files = (
        _listing_session(spark).readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("pathGlobFilter", "*.sql").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    return _shaped(files, F.col("path"), F.col("modificationTime"), F.col("length"), F.col("content"))


def ingest(scripts: DataFrame, out: str, checkpoint: str, available_now: bool = True, primary_only: bool = True) -> StreamingQuery:
    """Extract each batch and write it under its batch number; `primary_only=False` keeps every statement.

    A batch repeated after a failure overwrites its own folder, so every file counts once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        extract_lineage(batch, primary_only=primary_only).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(scripts, write, checkpoint, available_now)


def ingest_store(scripts: DataFrame, root: str, checkpoint: str, available_now: bool = True, primary_only: bool = True) -> StreamingQuery:
    """Extract each batch and commit it to the store at `root`, where `files.read_store` reads it.

    A batch is committed once under the name of its checkpoint, so one repeated after a failure changes nothing. A file
    whose text the store holds is not extracted again; other text replaces its records. The file stream gives a path
    once: edits of files it has given, and removals, come in by `plans.keep.refresh` on the same store.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        save_scripts(batch.sparkSession, batch, root, primary_only, writer=checkpoint, batch=batch_id)

    return _start(scripts, write, checkpoint, available_now)


def _start(scripts: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = scripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

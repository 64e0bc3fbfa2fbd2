"""Finding new files: a bounded stream that sees every file once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.tags import without_scheme
from seriesloom.sources.ledger import UNPROCESSED, container_id_of

#: The columns of Spark's binary file source.
BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def few_tasks(spark: SparkSession) -> dict[str, str]:
    """Settings for looking at many files of which only the names are wanted.

    Spark lists the files of a micro-batch again by a job of up to 10,000 tasks, and scans 32 small files a task.
    """
    parallelism = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    tasks = min(int(spark.conf.get(parallelism)), 4 * spark.sparkContext.defaultParallelism)
    return {parallelism: str(tasks), "spark.sql.files.openCostInBytes": "131072"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def new_files(spark: SparkSession, folder: str, max_files: int = 100, pattern: str | None = None) -> DataFrame:
    """The stream of files of a folder. Only paths are read, never the contents."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(without_scheme(F.col("path"), "file").alias("filename"), "modificationTime")


def discover(
    spark: SparkSession,
    folder: str,
    ledger: str | Callable[[DataFrame, int], None],
    checkpoint: str,
    max_files: int = 100,
    pattern: str | None = None,
    runs: int = 1,
) -> None:
    """Enter the files that are new since the last call into the ledger, one run for each ``max_files``, then return.

    A micro-batch holds up to ``runs`` runs. They are cut by the age of the files and loaded a microsecond apart, so the run
    of the oldest files comes first; all names of a micro-batch are put in order by one task.

    ``ledger`` is a folder, in which each micro-batch is a partition of its own, or a function of (rows, number) that
    enters a micro-batch. The number of a micro-batch and the files in it stay the same when it is repeated after a crash,
    and the run id is made of the number; so what enters rows by file or by number enters each file exactly once.
    """

    def into_folder(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    enter = ledger if callable(ledger) else into_folder

    def each(batch: DataFrame, number: int) -> None:
        run, loaded = F.sha2(F.lit(f"{checkpoint}:{number}"), 256), F.current_timestamp()
        if runs > 1:
            before = F.row_number().over(Window.orderBy("modificationTime", "filename")) - 1
            batch = batch.withColumn("_part", F.call_function("div", before, F.lit(max_files)))
            run = F.sha2(F.concat_ws(":", F.lit(f"{checkpoint}:{number}"), F.col("_part").cast("string")), 256)
            loaded = F.timestamp_micros(F.unix_micros(loaded) + F.col("_part"))
        enter(
            batch.select(
                container_id_of(F.col("filename")).alias("container_id"),
                run.alias("run_id"),
                "filename",
                F.lit(UNPROCESSED).alias("status"),
                loaded.alias("_load_ts"),
                F.lit(None).cast("timestamp").alias("_processing_done_ts"),
            ),
            number,
        )

    stream = new_files(spark, folder, max_files * runs, pattern).writeStream.foreachBatch(each)
    with settings(spark, few_tasks(spark)):  # the source reads them from this session whenever it lists a micro-batch
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

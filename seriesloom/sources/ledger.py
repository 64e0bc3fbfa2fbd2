"""The ledger of files: which are known, which run they belong to, and how the run ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.sources.tables import upsert

#: States of a file.
UNPROCESSED, IN_PROGRESS, FAILED, SUCCEEDED = "unprocessed", "in_progress", "failed", "succeeded"

NOOP = "noop"

LEDGER = T.StructType(
    [
        T.StructField("container_id", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("_load_ts", T.TimestampType()),
        T.StructField("_processing_done_ts", T.TimestampType()),
    ]
)


def container_id_of(filename: Column) -> Column:
    """The same id for a file in every run; plain parquet has no identity columns."""
    return F.xxhash64(filename)


def run_id_of(load_ts: Column) -> Column:
    return F.sha2(F.date_format(load_ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), 256)


def files_with_status(ledger: DataFrame, status: str) -> DataFrame:
    return ledger.where(F.col("status") == status)


def next_run(ledger: DataFrame, redo_active: bool = True, redo_failed: bool = True) -> DataFrame:
    """One row ``(decision, run_id)``.

    More than one active run, or an active one that must not be redone, is ``error``. Otherwise the active run, else the
    failed run loaded last (``skip_failed`` when failed runs must not be redone), else the unprocessed run loaded first,
    else ``noop``.
    """
    runs = ledger.groupBy("run_id", "status").agg(F.min("_load_ts").alias("lo"), F.max("_load_ts").alias("hi"))

    def of(status: str, value: Column) -> Column:
        return F.when(F.col("status") == status, value)

    found = runs.agg(
        F.count_if(F.col("status") == IN_PROGRESS).alias("n_active"),
        F.count_if(F.col("status") == FAILED).alias("n_failed"),
        F.count_if(F.col("status") == UNPROCESSED).alias("n_open"),
        F.max(of(IN_PROGRESS, F.col("run_id"))).alias("active"),
        F.max_by("run_id", of(FAILED, F.col("hi"))).alias("failed"),
        F.min_by("run_id", of(UNPROCESSED, F.col("lo"))).alias("open"),
    )
    one_active = F.col("n_active") == 1
    decision = (
        F.when(F.col("n_active") > 1, F.lit("error"))
        .when(one_active, F.lit("redo_active" if redo_active else "error"))
        .when(F.col("n_failed") > 0, F.lit("redo_failed" if redo_failed else "skip_failed"))
        .when(F.col("n_open") > 0, F.lit("process"))
        .otherwise(F.lit(NOOP))
    )
    rows = found.withColumn("decision", decision)
    run = (
        F.when(F.col("decision") == "redo_active", F.col("active"))
        .when(F.col("decision") == "redo_failed", F.col("failed"))
        .when(F.col("decision") == "process", F.col("open"))
        .otherwise(F.lit(NOOP))
    )
    return rows.select("decision", run.alias("run_id"))


def choose_run(ledger: DataFrame, redo_active: bool = True, redo_failed: bool = True) -> str:
    """The run to process, or ``noop``; an inconsistent ledger is an error."""
    row = next_run(ledger, redo_active, redo_failed).first()
    if row["decision"] == "error":
        raise RuntimeError("there is an active run that must be settled first")
    return row["run_id"]


def mark_run(ledger: DataFrame, run_id: str | Sequence[str], status: str, now: Column | None = None) -> DataFrame:
    """The ledger with a new state for the files of a run, or of several; success also sets the time of completion."""
    runs = [run_id] if isinstance(run_id, str) else list(run_id)
    changed = ledger.where(F.col("run_id").isin(runs)).withColumn("status", F.lit(status))
    update = ["status"]
    if status == SUCCEEDED:
        changed = changed.withColumn("_processing_done_ts", F.current_timestamp() if now is None else now)
        update.append("_processing_done_ts")
    return upsert(ledger, changed, ["filename", "run_id"], update)

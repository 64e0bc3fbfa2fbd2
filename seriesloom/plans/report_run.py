"""Reports over recordings that come and change: each run works on what is new or changed, in batches of recordings.

A batch is one partition of every fact table, written whole, and then one partition of the ledger of recordings, whose
presence makes the batch count. A batch that dies half way is invisible, and the next run writes over it. When a recording
changes, a later batch holds it again; readers take each recording from the newest batch that has it. So any number of
runs gives the tables that one run over everything would.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.series import ID, SampleSeries
from seriesloom.plans.definitions import ReportDefinition
from seriesloom.plans.report import Report, new_and_changed, session_batches

LEDGER = "processed"


@dataclass(frozen=True)
class ReportRun:
    """``channel``: the series of a physical signal from its tags; ``sessions``: one row per recording, with a column
    ``changed`` that grows when its data change. ``folder``: a shared folder for the tables.
    """

    spark: SparkSession
    definition: ReportDefinition
    channel: Callable[[Mapping[str, str]], SampleSeries]
    sessions: DataFrame
    folder: str
    changed: str = "stop_dt"
    order: Sequence[str] = ("container_id",)
    max_sessions: int = 10_000

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def processed(self) -> DataFrame:
        """The recordings in the report: the newest batch of each, and its state then."""
        if not self._exists(self._path(LEDGER)):
            kind = self.sessions.schema[self.changed].dataType
            key = self.sessions.schema[ID].dataType
            fields = [T.StructField(ID, key), T.StructField(self.changed, kind), T.StructField("batch", T.IntegerType())]
            return self.spark.createDataFrame([], T.StructType(fields))
        rows = self.spark.read.parquet(self._path(LEDGER))
        return rows.groupBy(ID).agg(F.max_by(self.changed, "batch").alias(self.changed), F.max("batch").alias("batch"))

    def run(self) -> list[int]:
        """Work on what is new or changed; returns the numbers of the batches written."""
        done = self.processed()
        todo = new_and_changed(self.sessions, done, self.changed)
        todo = session_batches(todo, self.max_sessions, self.order)
        first = (done.agg(F.max("batch")).first()[0] or 0) + 1
        count = todo.agg(F.max("batch")).first()[0]
        numbers = [] if count is None else list(range(first, first + count + 1))
        for number in numbers:
            self._write(number, todo.where(F.col("batch") == number - first))
        for name, df in self._report(self.channel).constant_tables().items():
            df.write.mode("overwrite").parquet(self._path(name))
        return numbers

    def _report(self, channel) -> Report:
        return Report(self.spark, self.definition, channel)

    def _write(self, number: int, sessions: DataFrame) -> None:
        ids = sessions.select(ID)
        if self.max_sessions <= 1_000_000:  # a batch has no more
            ids = F.broadcast(ids)

        def channel(tags: Mapping[str, str]) -> SampleSeries:
            whole = self.channel(tags)
            return SampleSeries(whole.frame.join(ids, ID, "left_semi"), whole.grid)

        report = self._report(channel)
        with report.shared():
            for name, df in report.fact_tables().items():
                df.write.mode("overwrite").parquet(f"{self._path(name)}/batch={number}")
        state = sessions.select(ID, self.changed)
        state.write.mode("overwrite").parquet(f"{self._path(LEDGER)}/batch={number}")

    def table(self, name: str) -> DataFrame:
        """A table of the report as of the newest batches."""
        rows = self.spark.read.parquet(self._path(name))
        if "batch" not in rows.columns:
            return rows
        current = self.processed().select(ID, "batch")
        return rows.join(current, [ID, "batch"], "left_semi").drop("batch")

"""The ingest job: find new files, pick a run, decode, encode, derive metadata, and settle the run in the ledger.

All tables are partitioned by run. A run writes its own partitions and nothing else, so doing it again replaces them,
rolling it back removes them, and runs never touch each other's files.

A small run costs little but the planning of its jobs, so ``run`` processes runs that were never tried in groups: the same
jobs once for all runs of a group. The first run stands for its group in the ledger until all are done, which is entered at
once; so at most one run is active, and what a crash leaves of the others is not read and is replaced. If a group fails,
its runs are done again one by one: the one at fault fails by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.tags import COMMENT_KEYS, MISSING
from seriesloom.operators.grid import TimeGrid, grid_of_bounds, measure_grid
from seriesloom.operators.runs import encode_runs
from seriesloom.plans.metadata import channel_metrics, channel_tags, container_metrics, path_tags
from seriesloom.sources.ledger import (
    FAILED,
    IN_PROGRESS,
    LEDGER,
    NOOP,
    SUCCEEDED,
    UNPROCESSED,
    choose_run,
    files_with_status,
    mark_run,
)
from seriesloom.sources.recordings import (
    Decoder,
    Enumerator,
    assign_bins,
    attach_containers,
    list_channels,
    number_channels,
    read_bins,
    split_channels,
)
from seriesloom.sources.scratch import scratch_folder
from seriesloom.sources.tables import VersionedTable, clustered
from seriesloom.streaming.discover import discover

TABLES = ("channels", "bronze", "slices", "silver", "channel_metrics", "container_metrics", "channel_tags", "container_tags")
#: The keys of a channel's tags.
CHANNEL_TAGS = (
    "group_idx", "channel_idx", "channel_name", "unit", "brand", "model", "from_city", "to_city", "condition", "experiment_id"
)
PIECES_PER_SHARD = 10_000
NO_SLICES = "container_id bigint, starts array<bigint>, copies boolean"
#: A group has at most so many times the runs of the group before it, so many files, and, by what the group before it held,
#: about so many samples; a single run may have more.
GROWTH, GROUP_FILES, GROUP_SAMPLES = 16, 100_000, 100_000_000


@dataclass(frozen=True)
class IngestJob:
    """``root``: a shared folder for the ledger, the tables and the stream's checkpoint."""

    spark: SparkSession
    root: str
    enumerate_file: Enumerator
    decode: Decoder
    ticks_per_second: int
    max_files: int = 100
    max_samples: int = 1_000_000
    min_samples: int = 0
    shards: int | None = None  # by the number of pieces
    pattern: str | None = None
    vehicle: Callable[[Column], Column] = lambda filename: F.lit("NA")  # the vehicle that a file name tells

    @property
    def ledger(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/ledger")

    def table(self, name: str) -> DataFrame:
        """A table over all successful runs."""
        done = self.ledger.read().where(F.col("status") == SUCCEEDED).select("run_id").distinct()
        return self.spark.read.parquet(f"{self.root}/{name}").join(done, "run_id", "left_semi")

    def grid(self) -> TimeGrid:
        """The time grid of all recordings, as the runs measured it when they wrote them."""
        return grid_of_bounds(self.spark, f"{self.root}/slices", "container_id", self.ticks_per_second)

    def find(self, folder: str) -> None:
        """Enter the files that are new since the last call; one run for each ``max_files`` of them."""
        self.ledger.create(LEDGER)

        def enter(rows: DataFrame, number: int) -> None:
            folder = scratch_folder(self.spark, "found")
            rows.write.parquet(folder)  # the files are asked for their names once
            known = self.ledger.read()
            rows = self.spark.read.schema(LEDGER).parquet(folder)
            new = rows.join(known.select("filename"), "filename", "left_anti").select(*known.columns)
            if not new.isEmpty():
                self.ledger.write(known.unionByName(new))

        discover(self.spark, folder, enter, f"{self.root}/checkpoint", self.max_files, self.pattern, self._most_runs)

    def next(self, redo_active: bool = True, redo_failed: bool = True) -> str:
        """Process one run and return its id; ``noop`` if none is open. A run that fails is rolled back and marked."""
        run = choose_run(self.ledger.read(), redo_active, redo_failed)
        if run != NOOP:
            self._settle([run])
        return run

    def run(self, folder: str) -> list[str]:
        """Find new files and process all open runs."""
        self.find(folder)
        done, most, single = [], 1, 0
        while (run := choose_run(self.ledger.read())) != NOOP:
            group = [run] if most == 1 else self._group(run, most)
            samples = self._settle(group)
            if samples is None:
                most, single = 1, len(group)
                continue
            done += group
            single -= 1
            wanted = GROUP_SAMPLES * len(group) // max(1, samples)
            most = 1 if single > 0 else max(1, min(GROWTH * len(group), self._most_runs, wanted))
        return done

    def roll_back(self, run: str) -> None:
        """Remove what a run has written."""
        for name in TABLES:
            files, path = self._place(self._part(name, run))
            files.delete(path, True)

    @property
    def _most_runs(self) -> int:
        return max(1, GROUP_FILES // self.max_files)

    def _part(self, name: str, run: str) -> str:
        return f"{self.root}/{name}/run_id={run}"

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _mark(self, runs: Sequence[str], status: str) -> None:
        self.ledger.write(mark_run(self.ledger.read(), runs, status))

    def _group(self, run: str, most: int) -> list[str]:
        """``run`` and the runs to do with it: those that come after it, if it was never tried."""
        tried = F.max(F.col("status") != UNPROCESSED)
        rows = self.ledger.read().groupBy("run_id").agg(F.min("_load_ts").alias("at"), tried.alias("tried"))
        first = rows.where(~F.col("tried")).orderBy("at", "run_id").limit(most).collect()
        others = [r["run_id"] for r in first]
        return [run, *[r for r in others if r != run]] if run in others else [run]

    def _settle(self, runs: list[str]) -> int | None:
        """Process the runs and mark them; the samples they hold, or None where a group failed and was rolled back."""
        self._mark(runs[:1], IN_PROGRESS)
        active = files_with_status(self.ledger.read(), IN_PROGRESS).select("run_id").distinct().count()
        if active != 1:
            raise RuntimeError(f"{active} runs are active; one must be")
        try:
            samples = self._process(runs)
        except Exception:
            for run in runs:
                self.roll_back(run)
            if len(runs) > 1:
                return None
            self._mark(runs, FAILED)
            raise
        self._mark(runs, SUCCEEDED)
        return samples

    def _write(self, rows: DataFrame, name: str, files: DataFrame, runs: list[str], keys: Sequence[str] | None = ()) -> DataFrame:
        """The rows of the runs' recordings as partitions of a table. ``keys``: by what the rows are clustered; None: they
        stay as they lie."""
        if len(runs) == 1:
            rows = clustered(rows, keys) if keys else rows
            rows.write.mode("overwrite").parquet(self._part(name, runs[0]))
            return self.spark.read.parquet(self._part(name, runs[0])).withColumn("run_id", F.lit(runs[0]))
        columns = rows.columns
        rows = rows.join(F.broadcast(files.select("container_id", "run_id")), "container_id").select(*columns, "run_id")
        if keys is not None:  # else every task would have a file for every run
            rows = clustered(rows, ["run_id", *keys]) if keys else rows.repartition("run_id")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run_id").parquet(f"{self.root}/{name}")
        self._fill(rows.drop("run_id"), name, runs)
        parts = [self._part(name, run) for run in runs]
        schema = rows.schema
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*parts)

    def _fill(self, rows: DataFrame, name: str, runs: list[str]) -> None:
        """A run without rows has its partition too, with an empty file."""
        places = [self._place(self._part(name, run)) for run in runs]
        missing = [path for files, path in places if not files.exists(path)]
        if not missing:
            return
        folder = scratch_folder(self.spark, "empty")
        self.spark.createDataFrame([], rows.schema).write.parquet(folder)
        files, source = self._place(folder)
        conf = self.spark._jsc.hadoopConfiguration()
        for path in missing:
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, path.getFileSystem(conf), path, False, conf)

    def _process(self, runs: list[str]) -> int:
        """Write all tables of the runs; the number of their samples."""
        files = self.ledger.read().where(F.col("run_id").isin(runs)).select("filename", "container_id", "run_id")
        if len(runs) > 1:
            for run in runs:
                self.roll_back(run)
        found = attach_containers(number_channels(list_channels(files, self.enumerate_file, self.min_samples)), files)
        channels = self._write(found, "channels", files, runs)
        pieces = split_channels(channels, self.max_samples)
        counts = pieces.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_samples").alias("samples"))
        most, samples = counts.agg(F.max("n"), F.sum("samples")).first()
        # the pieces of a shard are put in order by one task; a shard has pieces of one run only
        shards = self.shards or 1 + (most or 0) // PIECES_PER_SHARD
        shard = F.struct("run_id", F.pmod(F.xxhash64("filename"), F.lit(shards)))
        bins = assign_bins(pieces, self.max_samples, shard)
        bronze = self._write(read_bins(bins, self.decode), "bronze", files, runs, None)
        grid = measure_grid(bronze, self.ticks_per_second)
        cuts = self.spark.createDataFrame([], NO_SLICES) if grid.bounds is None else self.spark.read.parquet(grid.bounds.path)
        self._write(cuts, "slices", files, runs)
        self._write(encode_runs(bronze, grid), "silver", files, runs, ["container_id", "channel_id", "tstart"])
        self._write(channel_metrics(bronze, self.ticks_per_second), "channel_metrics", files, runs)
        told = F.when(F.col("vehicle_key") != MISSING, F.col("vehicle_key")).otherwise(self.vehicle(F.col("filename")))
        recordings = container_metrics(bronze.withColumn("vehicle_key", told), self.ticks_per_second)
        self._write(recordings, "container_metrics", files, runs)
        self._write(channel_tags(channels, CHANNEL_TAGS), "channel_tags", files, runs)
        tags = channels.groupBy("container_id", "filename").agg(*[F.min(F.when(F.col(k) != MISSING, F.col(k))).alias(k) for k in COMMENT_KEYS])
        named = tags.na.fill(MISSING, list(COMMENT_KEYS)).unpivot(["container_id"], list(COMMENT_KEYS), "key", "value")
        self._write(path_tags(files).unionByName(named), "container_tags", files, runs)
        return samples or 0

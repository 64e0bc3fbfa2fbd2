"""The given tables seen as measurement data.

``events`` is the sample table: a user is a recording, an event type is a channel, ``ts`` and ``value`` are the samples.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.times import micros_of
from seriesloom.operators.grid import TimeGrid, measure_grid
from seriesloom.operators.runs import encode_runs
from seriesloom.operators.scans import running_sum, scan
from seriesloom.operators.series import Intervals, SampleSeries
from seriesloom.plans.catalog import MeasurementCatalog
from seriesloom.plans.metadata import channel_metrics, channel_tags, container_metrics
from seriesloom.plans.profile import AliasMap, ChannelMap, Profile
from seriesloom.sources.scratch import scratch_folder
from seriesloom.sources.tables import BucketedTable, clustered

TICKS = 1_000_000
HOUR = 3600 * TICKS
DAY = 24 * HOUR
CHANNELS = ("click", "error", "purchase", "signup", "view")
UNITS = {"click": "rpm", "error": "°C", "purchase": "km", "signup": "rpm", "view": "km/h"}
LEVEL = 50


class Data:
    """One folder of tables. Everything is lazy; the time grid is measured once per folder."""

    _known: dict[tuple[str, str], Data] = {}
    #: Set by tests to force a slice width.
    grid_override: TimeGrid | None = None
    #: Rows of a slice; set by tests to force slices of large recordings.
    target_rows = 4_000_000

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.memo: dict = {}

    @classmethod
    def forget(cls) -> None:
        """Drop what earlier calls measured and wrote, so that the next call pays for it again."""
        cls._known.clear()

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Data:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._known:
            cls._known[key] = cls(spark, folder)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        """The sample rows with channel number, unit and vehicle."""
        kind = F.col("event_type")
        number = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), kind).cast("int")
        unit = F.when(F.lit(False), F.lit(""))
        for name, u in UNITS.items():
            unit = unit.when(kind == name, F.lit(u))
        return self.table("events").select(
            F.col("user_id").alias("container_id"),
            number.alias("channel_id"),
            kind.alias("channel_name"),
            unit.alias("unit"),
            F.concat(F.lit("veh_"), (F.col("user_id") % 7).cast("string")).alias("vehicle_key"),
            micros_of(F.col("ts")).alias("time"),
            "value",
            "props",
        )

    @property
    def grid(self) -> TimeGrid:
        if self.grid_override is not None:
            return self.grid_override
        if "grid" not in self.memo:
            self.memo["grid"] = measure_grid(self.samples, TICKS, target_rows=self.target_rows)
        return self.memo["grid"]

    def channel_samples(self, name: str) -> DataFrame:
        """Samples of one channel; the filter reaches the file scan."""
        return self.samples.where(F.col("channel_name") == name)

    # -- series --------------------------------------------------------------------------------------------------
    @property
    def runs(self) -> DataFrame:
        """Run-length encoded values of all channels."""
        return encode_runs(self.samples, self.grid)

    @property
    def silver(self) -> DataFrame:
        """The runs of all channels as the ingest job leaves them for reports: a written table, by recording."""
        if ("silver", self.grid) not in self.memo:
            folder = scratch_folder(self.spark, "silver")
            if self.grid.sliced:
                clustered(self.runs, ["container_id", "channel_id", "tstart"]).write.parquet(folder)
                self.memo["silver", self.grid] = lambda: self.spark.read.parquet(folder)
            else:
                buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                table = BucketedTable(self.spark, folder, "container_id", ["channel_id", "tstart"], buckets)
                table.write(encode_runs(table.deal(self.samples), self.grid), dealt=True)
                self.memo["silver", self.grid] = table.read
        return self.memo["silver", self.grid]()

    @property
    def silver_tags(self) -> DataFrame:
        """The tags of all channels as the ingest job leaves them."""
        if "tags" not in self.memo:
            folder = scratch_folder(self.spark, "tags")
            channel_tags(self.samples, ["channel_name", "unit"]).write.parquet(folder)
            self.memo["tags"] = folder
        return self.spark.read.parquet(self.memo["tags"])

    def _encoded(self, name: str, samples: DataFrame) -> DataFrame:
        """The runs of one channel. On a sliced grid they are written once and read back, as the silver table would be.

        One channel needs the recording only as key; what follows on the same key is then placed already.
        """
        runs = encode_runs(samples, self.grid, keys=("container_id",))
        if not self.grid.sliced:
            return runs
        if (name, self.grid) not in self.memo:
            folder = scratch_folder(self.spark, "runs")
            runs.write.parquet(folder)
            self.memo[name, self.grid] = folder
        return self.spark.read.parquet(self.memo[name, self.grid])

    @property
    def levels(self) -> DataFrame:
        """Run-length encoded coarse values (steps of ``LEVEL``) of all channels."""
        return encode_runs(self._coarse(self.samples), self.grid)

    @staticmethod
    def _coarse(samples: DataFrame) -> DataFrame:
        return samples.withColumn("value", F.floor(F.col("value") / LEVEL).cast("double"))

    def signal(self, name: str) -> SampleSeries:
        return SampleSeries(self._encoded(f"runs {name}", self.channel_samples(name)), self.grid)

    def level(self, name: str) -> SampleSeries:
        return SampleSeries(self._encoded(f"levels {name}", self._coarse(self.channel_samples(name))), self.grid)

    @property
    def odometer(self) -> SampleSeries:
        """A rising signal: running total of the whole purchase values."""
        rows = self.signal("purchase").frame.withColumn("_step", F.floor("value").cast("double"))
        rows = scan(
            rows, ("container_id",), ("tstart", "tend"), self.grid, "tstart", _total=running_sum(F.col("_step"))
        )
        return SampleSeries(rows.withColumn("value", F.col("_total")), self.grid)

    def hot(self) -> Intervals:
        return self.signal("click") > 40

    def busy(self) -> Intervals:
        return self.signal("view") > 30

    # -- metadata ------------------------------------------------------------------------------------------------
    @property
    def channel_metrics(self) -> DataFrame:
        names = self.samples.select("container_id", "channel_id", "channel_name", "unit").distinct()
        return channel_metrics(self.samples, TICKS).join(names, ["container_id", "channel_id"])

    @property
    def container_metrics(self) -> DataFrame:
        return container_metrics(self.samples, TICKS)

    @property
    def aliases(self) -> DataFrame:
        """One alias per channel name and vehicle."""
        rows = self.samples.select("channel_name", "unit", "vehicle_key").distinct()
        return rows.select(
            F.concat_ws("_", "channel_name", "vehicle_key").alias("channel_alias_name"),
            "channel_name",
            "unit",
            F.concat(F.lit("about "), F.col("channel_name")).alias("description"),
        )

    def catalog(self, profile: Profile | None = None) -> MeasurementCatalog:
        tags = self.samples.select("container_id", "channel_id", "channel_name", "unit").distinct()
        channel_tags = tags.unpivot(["container_id", "channel_id"], ["channel_name", "unit"], "key", "value")
        vehicle = self.samples.select("container_id", "vehicle_key").distinct()
        container_tags = vehicle.unpivot(["container_id"], ["vehicle_key"], "key", "value")
        tables = {
            "container_metrics": self.container_metrics,
            "channel_metrics": self.channel_metrics,
            "container_tags": container_tags,
            "channel_tags": channel_tags,
            "channels": self.runs,
            "aliases": self.aliases,
        }
        return MeasurementCatalog(tables, profile or Profile(ticks_per_second=TICKS))


def alias_profile(**changes) -> Profile:
    """A profile whose channel units come from the alias table and whose tags are made up."""
    return Profile(
        channels=ChannelMap(),
        aliases=AliasMap(table="aliases"),
        ticks_per_second=TICKS,
        **changes,
    )

"""Questions about recordings, vehicles and channels, asked through a profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.plans.profile import Profile

VEHICLE_KEY = "vehicle_key"

@dataclass(frozen=True)
class VehicleFilter:
    """Recordings of one vehicle in a time range; bounds that are None are open."""

    vehicle: str
    start: str | None = None
    stop: str | None = None
    max_seconds: float | None = None


def container_filter(
    vehicles: Sequence[VehicleFilter],
    vehicle: str = "vehicle_key",
    start: str = "start_dt",
    stop: str = "stop_dt",
    seconds: str = "duration_s",
) -> Column:
    """Any of the vehicles, each with all of its bounds."""
    if not vehicles:
        raise ValueError("at least one vehicle")
    ways = []
    for v in vehicles:
        test = F.col(vehicle) == v.vehicle
        if v.max_seconds is not None:
            test = test & (F.col(seconds) <= F.lit(v.max_seconds))
        if v.start:
            test = test & (F.col(start) >= F.lit(v.start).cast("timestamp"))
        if v.stop:
            test = test & (F.col(stop) <= F.lit(v.stop).cast("timestamp"))
        ways.append(test)
    return reduce(lambda a, b: a | b, ways)


def known_vehicles(df: DataFrame, column: str) -> DataFrame:
    """Rows with a usable vehicle id."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "NA"))


def of_run(df: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    """Rows of the recordings of one run; a semi join, so no list of ids passes through the driver."""
    mine = ledger.where(F.col("run_id") == run_id).select("container_id")
    return df.join(mine, "container_id", "left_semi")


def session_columns(df: DataFrame, columns: Sequence[str], casts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A column subset plus cast copies ``(existing, new, type)``; the originals stay."""
    kept = df.select(*columns)
    return kept.withColumns({new: F.col(old).cast(kind) for old, new, kind in casts})


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old != new})


class MeasurementCatalog:
    """``tables`` maps table names of the profile to DataFrames; other names are looked up in the session catalog."""

    def __init__(self, tables: Mapping[str, DataFrame], profile: Profile | None = None) -> None:
        self.tables = dict(tables)
        self.profile = profile or Profile()

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return next(iter(self.tables.values())).sparkSession.table(name)

    # -- canonical tables ----------------------------------------------------------------------------------------
    def containers(self) -> DataFrame:
        c = self.profile.containers
        return self.table(c.table).select(
            F.expr(c.id).alias("container_id"), F.expr(c.start).alias("start_dt"), F.expr(c.stop).alias("stop_dt")
        )

    def channel_metrics(self) -> DataFrame:
        c = self.profile.channels
        rate = F.expr(c.sample_rate) if c.sample_rate else F.lit(None).cast("double")
        return self.table(c.table).select(
            F.expr(c.container_id).alias("container_id"),
            F.expr(c.id).alias("channel_id"),
            F.expr(c.sample_count).alias("sample_count"),
            F.expr(c.min).alias("min"),
            F.expr(c.max).alias("max"),
            F.expr(c.mean).alias("mean"),
            rate.alias("sample_rate"),
        )

    def container_tags(self) -> DataFrame:
        """The tags table, or one made of the recordings: a file name and, by rule, a vehicle."""
        p = self.profile
        if p.tags.container_table:
            return self.table(p.tags.container_table).select(
                F.expr(p.tags.container_id).alias("container_id"), "key", "value"
            )
        known = {"filename": F.expr(p.containers.id).cast("string")}
        if p.vehicle.source == "constant":
            known[VEHICLE_KEY] = F.lit(p.vehicle.constant)
        elif p.vehicle.source == "column":
            known[VEHICLE_KEY] = F.expr(p.vehicle.column).cast("string")
        return _as_tags(self.table(p.containers.table), {"container_id": F.expr(p.containers.id)}, known)

    def channel_tags(self) -> DataFrame:
        """The tags table, or one made of the channels: name and unit (own column, alias table, or empty)."""
        p = self.profile
        if p.tags.channel_table:
            return self.table(p.tags.channel_table).select(
                F.expr(p.tags.channel_container_id).alias("container_id"),
                F.expr(p.tags.channel_id).alias("channel_id"),
                "key",
                "value",
            )
        c = p.channels
        rows = self.table(c.table)
        unit = F.lit("")
        if c.unit:
            unit = F.coalesce(F.expr(c.unit), F.lit(""))
        elif p.aliases.table and p.aliases.unit:
            rows = self._with_alias_unit(rows)
            unit = F.coalesce(F.col("_alias_unit"), F.lit(""))
        ids = {"container_id": F.expr(c.container_id), "channel_id": F.expr(c.id)}
        return _as_tags(rows, ids, {"channel_name": F.expr(c.name), "unit": unit})

    def _with_alias_unit(self, rows: DataFrame) -> DataFrame:
        c, a = self.profile.channels, self.profile.aliases
        keys = [c.name, c.second_id] if c.second_id else [c.name]
        units = self.table(a.table).select(*keys, F.col(a.unit).alias("_alias_unit"))
        return rows.join(units, keys, "left")

    def _tag(self, tags: DataFrame, key: str, name: str) -> DataFrame:
        ids = [c for c in tags.columns if c not in ("key", "value")]
        return tags.where(F.col("key") == key).select(*ids, F.col("value").alias(name))

    # -- lists ---------------------------------------------------------------------------------------------------
    def containers_list(self) -> DataFrame:
        """Recordings with vehicle, number of channels and duration, newest first."""
        counts = self.channel_metrics().groupBy("container_id").agg(F.count(F.lit(1)).alias("num_channels"))
        vehicle = self._tag(self.container_tags(), VEHICLE_KEY, "vehicle_key")
        rows = self.containers().join(vehicle, "container_id", "left").join(counts, "container_id", "left")
        return rows.select(
            "container_id",
            F.coalesce("vehicle_key", F.lit("")).alias("vehicle_key"),
            "start_dt",
            "stop_dt",
            F.coalesce("num_channels", F.lit(0).cast("long")).alias("num_channels"),
            (F.unix_millis("stop_dt") - F.unix_millis("start_dt")).alias("duration_ms"),
        ).orderBy(F.desc("start_dt"))

    def vehicle_candidates(self) -> DataFrame:
        """Vehicles with their number of recordings."""
        p = self.profile
        if p.vehicle.source == "constant":
            return (
                self.containers()
                .groupBy(F.lit(p.vehicle.constant).alias("vehicle_id"))
                .agg(F.count(F.lit(1)).alias("container_count"))
            )
        if p.vehicle.source == "column":
            rows = self.table(p.containers.table).select(
                F.expr(p.containers.id).alias("container_id"), F.expr(p.vehicle.column).cast("string").alias("vehicle_id")
            )
            rows = rows.where(F.col("vehicle_id").isNotNull())
        else:
            rows = known_vehicles(self._tag(self.container_tags(), VEHICLE_KEY, "vehicle_id"), "vehicle_id")
        return (
            rows.groupBy("vehicle_id")
            .agg(F.countDistinct("container_id").alias("container_count"))
            .orderBy("vehicle_id")
        )

    def _named_channels(self) -> DataFrame:
        tags = self.channel_tags()
        names = self._tag(tags, "channel_name", "channel_name")
        units = self._tag(tags, "unit", "unit")
        return names.join(units, ["container_id", "channel_id"], "left")

    def signals_list(self, container_id) -> DataFrame:
        """Channels of one recording with unit and metrics."""
        here = F.col("container_id") == F.lit(container_id)
        rows = self._named_channels().where(here)
        metrics = self.channel_metrics().where(here)
        return (
            rows.join(metrics, ["container_id", "channel_id"], "left")
            .select(
                "channel_id",
                "channel_name",
                F.coalesce("unit", F.lit("")).alias("unit"),
                "sample_count",
                "min",
                "max",
                "mean",
                "sample_rate",
            )
            .orderBy("channel_name")
        )

    def containers_of(self, vehicles: Sequence[str]) -> DataFrame:
        """Ids of the recordings of some vehicles."""
        p = self.profile
        if p.vehicle.source == "constant":
            return self.containers().select("container_id")
        if p.vehicle.source == "column":
            mine = F.expr(p.vehicle.column).cast("string").isin(list(vehicles))
            return self.table(p.containers.table).where(mine).select(F.expr(p.containers.id).alias("container_id"))
        tags = self.container_tags()
        return tags.where((F.col("key") == VEHICLE_KEY) & F.col("value").isin(list(vehicles))).select("container_id")

    def channel_catalog(self, vehicles: Sequence[str] | None = None) -> DataFrame:
        """Channels over all recordings, or over those of some vehicles."""
        rows = self._named_channels().join(self.channel_metrics(), ["container_id", "channel_id"])
        if vehicles:
            rows = rows.join(self.containers_of(vehicles), "container_id", "left_semi")
        return (
            rows.groupBy("channel_name", F.coalesce("unit", F.lit("")).alias("unit"))
            .agg(
                F.sum("sample_count").cast("long").alias("sample_count"),
                F.min("min").alias("min_value"),
                F.max("max").alias("max_value"),
                F.avg("mean").alias("mean_value"),
                F.avg("sample_rate").alias("sample_rate"),
                F.countDistinct("container_id").alias("container_count"),
            )
            .orderBy("channel_name")
        )

    def alias_search(self, keyword: str, limit: int | None = None) -> DataFrame:
        """Aliases whose alias or channel name holds the keyword. The keyword is a value, never SQL text."""
        p = self.profile
        if not p.aliases.table:
            raise ValueError("the profile has no alias table")
        a, c = p.aliases, p.channels
        alias, name = F.col(a.alias), F.col(c.name)
        found = (
            self.table(a.table)
            .where(alias.contains(keyword) | name.contains(keyword))
            .select(
                alias.alias("channel_alias_name"),
                name.alias("channel_name"),
                name.alias("signal"),
                (F.col(c.second_id) if c.second_id else F.lit("")).alias("device_name"),
                (F.col(c.second_id) if c.second_id else F.lit(None).cast("string")).alias("network"),
                (F.col(a.unit) if a.unit else F.lit(None).cast("string")).alias("unit"),
                (F.col(a.description) if a.description else F.lit(None).cast("string")).alias("description"),
            )
            .orderBy("channel_alias_name")
        )
        return found if limit is None else found.limit(limit)

    def data_time_range(self, vehicles: Sequence[str] | None = None) -> DataFrame:
        rows = self.containers()
        if vehicles:
            rows = rows.join(self.containers_of(vehicles), "container_id", "left_semi")
        return rows.agg(F.min("start_dt").alias("min_start"), F.max("stop_dt").alias("max_stop"))

    def vehicle_volume(self) -> DataFrame:
        """Vehicles by number of recordings, with first and last data."""
        vehicle = self._tag(self.container_tags(), VEHICLE_KEY, "vehicle_id")
        return (
            self.containers()
            .join(vehicle, "container_id")
            .groupBy("vehicle_id")
            .agg(
                F.count(F.lit(1)).alias("session_count"),
                F.min("start_dt").alias("first_data"),
                F.max("stop_dt").alias("last_data"),
            )
            .orderBy(F.desc("session_count"), "vehicle_id")
        )

    def vehicle_channels(self, vehicle: str) -> DataFrame:
        """Distinct channels (name, unit and ranges) of one vehicle."""
        rows = self._named_channels().join(self.channel_metrics(), ["container_id", "channel_id"])
        rows = rows.join(self.containers_of([vehicle]), "container_id", "left_semi")
        return rows.select(
            "channel_name", "unit", "sample_count", F.col("min").alias("min_value"), F.col("max").alias("max_value")
        ).distinct()

    # -- samples -------------------------------------------------------------------------------------------------
    def series(self) -> DataFrame:
        """The series table in canonical columns; ``tend`` only if the profile has an end."""
        s, c = self.profile.series, self.profile.channels
        cols = [
            F.expr(s.container_match or c.container_id).alias("container_id"),
            F.expr(s.channel_match or c.id).alias("channel_id"),
            F.expr(s.time).alias("tstart"),
            *([F.expr(s.end).alias("tend")] if s.end else []),
            F.expr(s.value).alias("value"),
        ]
        return self.table(s.table).select(*cols)

    def fetch_channel(self, container_id, channel_id) -> DataFrame:
        """One channel of one recording; both filters reach the file scan."""
        rows = self.series().where(
            (F.col("container_id") == F.lit(container_id)) & (F.col("channel_id") == F.lit(channel_id))
        )
        return rows.drop("container_id", "channel_id")

    def channels_matching(self, **tags: str) -> DataFrame:
        """Ids of the channels that have all of the given tags; alias names are resolved by the alias table."""
        if not tags:
            raise ValueError("at least one tag")
        ids = ["container_id", "channel_id"]
        found: DataFrame | None = None
        rows = self.channel_tags()
        for key, value in tags.items():
            if key == self.profile.aliases.alias and self.profile.aliases.table:
                named = self.table(self.profile.aliases.table).where(F.col(key) == value)
                names = named.select(F.col(self.profile.channels.name).alias("value"))
                hit = rows.where(F.col("key") == "channel_name").join(names, "value", "left_semi")
            else:
                hit = rows.where((F.col("key") == key) & (F.col("value") == value))
            hit = hit.select(*ids)
            found = hit.distinct() if found is None else found.join(hit, ids, "left_semi")
        return found


def _as_tags(df: DataFrame, ids: Mapping[str, Column], known: Mapping[str, Column]) -> DataFrame:
    """One row per tag, made in one pass over the table."""
    pair = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in known.items()]
    rows = df.select(*[c.alias(n) for n, c in ids.items()], F.explode(F.array(*pair)).alias("_tag"))
    return rows.select(*ids, "_tag.key", "_tag.value")

"""Where a customer's tables keep what: names, columns and SQL expressions for the canonical model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class ContainerMap:
    """The recordings table."""

    table: str = "container_metrics"
    id: str = "container_id"
    start: str = "start_dt"
    stop: str = "stop_dt"


@dataclass(frozen=True)
class ChannelMap:
    """The channels table. ``second_id`` tells apart equal names on different networks."""

    table: str = "channel_metrics"
    container_id: str = "container_id"
    id: str = "channel_id"
    name: str = "channel_name"
    second_id: str | None = None
    unit: str | None = None
    min: str = "min"
    max: str = "max"
    mean: str = "mean"
    sample_count: str = "sample_count"
    sample_rate: str | None = "sample_rate"


@dataclass(frozen=True)
class TagMap:
    """Key/value tables of recordings and channels; a missing table is made up from the metrics."""

    container_table: str | None = "container_tags"
    container_id: str = "container_id"
    channel_table: str | None = "channel_tags"
    channel_container_id: str = "container_id"
    channel_id: str = "channel_id"


@dataclass(frozen=True)
class AliasMap:
    table: str | None = None
    alias: str = "channel_alias_name"
    unit: str | None = "unit"
    description: str | None = "description"


@dataclass(frozen=True)
class SeriesMap:
    """The runs (``end`` set) or samples (``end`` None) table; time, end and value may be SQL expressions."""

    table: str = "channels"
    time: str = "tstart"
    end: str | None = "tend"
    value: str = "value"
    container_match: str | None = None
    channel_match: str | None = None


@dataclass(frozen=True)
class VehicleRule:
    """How a recording knows its vehicle: a ``vehicle_key`` tag, a column of the recordings table, or a constant."""

    source: str = "tag"
    column: str | None = None
    constant: str | None = None


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    containers: ContainerMap = field(default_factory=ContainerMap)
    channels: ChannelMap = field(default_factory=ChannelMap)
    tags: TagMap = field(default_factory=TagMap)
    aliases: AliasMap = field(default_factory=AliasMap)
    series: SeriesMap = field(default_factory=SeriesMap)
    vehicle: VehicleRule = field(default_factory=VehicleRule)
    ticks_per_second: int = 1_000_000_000

    def __post_init__(self) -> None:
        rule = self.vehicle
        if rule.source not in ("tag", "column", "constant"):
            raise ValueError(f"unknown vehicle source {rule.source!r}")
        if rule.source == "tag" and self.tags.container_table is None:
            raise ValueError("a vehicle tag needs a container tags table")
        if rule.source == "column" and not rule.column:
            raise ValueError("a vehicle column needs its name")
        if rule.source == "constant" and not rule.constant:
            raise ValueError("a constant vehicle needs its value")

    def override(self, changes: Mapping[str, str | None]) -> Profile:
        """A profile with some ``part.field`` entries replaced; None means "leave as it is"."""
        parts: dict[str, dict[str, str]] = {}
        for path, value in changes.items():
            part, _, name = path.partition(".")
            known = part in _PARTS and name in {f.name for f in fields(getattr(self, part))}
            if not known:
                raise KeyError(f"unknown profile entry {path!r}")
            if value is not None:
                parts.setdefault(part, {})[name] = value
        return replace(self, **{p: replace(getattr(self, p), **new) for p, new in parts.items()})

    def override_source(self, changes: Mapping[str, str | None]) -> Profile:
        """Session overrides of the viewer: entries that do not belong to the sample source are dropped."""
        return self.override({k: v for k, v in changes.items() if k in SOURCE_ENTRIES})

    def renames(self) -> dict[str, dict[str, str]]:
        """Per table: physical column -> canonical column, without the ones that already have the canonical name."""
        c, s = self.channels, self.series
        wanted = {
            "container_metrics": [(self.containers.id, "container_id")],
            "channel_metrics": [(c.container_id, "container_id"), (c.id, "channel_id")],
            "channels": [
                (s.container_match or c.container_id, "container_id"),
                (c.id, "channel_id"),
                (s.time, "tstart"),
                (s.end, "tend"),
                (s.value, "value"),
            ],
        }
        if self.tags.container_table:
            wanted["container_tags"] = [(self.tags.container_id, "container_id")]
        if self.tags.channel_table:
            wanted["channel_tags"] = [
                (self.tags.channel_container_id, "container_id"),
                (self.tags.channel_id, "channel_id"),
            ]
        named = {t: {old: new for old, new in pairs if old and old != new} for t, pairs in wanted.items()}
        return {t: pairs for t, pairs in named.items() if pairs}


_PARTS = ("containers", "channels", "tags", "aliases", "series", "vehicle")

#: Entries a viewer session may change.
SOURCE_ENTRIES = (
    "series.table",
    "series.time",
    "series.value",
    "series.container_match",
    "series.channel_match",
    "channels.container_id",
    "channels.id",
    "channels.name",
)

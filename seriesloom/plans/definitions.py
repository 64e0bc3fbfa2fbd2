"""What a report contains: signals, events and aggregations, as plain data with checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from seriesloom.functions.binning import check_edges
from seriesloom.operators.statistics import DEFAULT_LABELS, LABELS

#: Comparison operators, ways to combine conditions, and event kinds with their result type.
COMPARISONS = (">", "<", ">=", "<=", "==", "!=")
LOGIC = ("AND", "OR")
EVENT_TYPES = {
    "interval": "Intervals",
    "rising_edges": "PointsInTime",
    "falling_edges": "PointsInTime",
    "change_points": "PointsInTime",
    "periodic_distance": "Intervals",
}


@dataclass(frozen=True)
class Signal:
    """Physical (``channel``: tags of the channel) or virtual (``build``: a function of the signals by name)."""

    name: str
    channel: Mapping[str, str] | None = None
    build: Callable[[Mapping], object] | None = None
    label: str | None = None

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} is not usable as a name")
        if (self.channel is None) == (self.build is None):
            raise ValueError("a signal is either a channel or built from other signals")


@dataclass(frozen=True)
class Threshold:
    signal: str
    operator: str
    value: float

    def __post_init__(self) -> None:
        if self.operator not in COMPARISONS:
            raise ValueError(f"unknown comparison {self.operator!r}")


@dataclass(frozen=True)
class Event:
    name: str
    kind: str
    conditions: Sequence[Threshold] = ()
    logic: str = "AND"
    signal: str | None = None
    from_state: float | None = None
    to_state: float | None = None
    step: float | None = None

    def __post_init__(self) -> None:
        if self.kind not in EVENT_TYPES:
            raise ValueError(f"unknown event kind {self.kind!r}")
        if self.logic not in LOGIC:
            raise ValueError(f"unknown logic {self.logic!r}")
        if self.kind in ("interval", "rising_edges", "falling_edges") and not self.conditions:
            raise ValueError(f"{self.kind} events need at least one condition")
        if self.kind == "change_points" and (
            not self.signal or self.from_state is None or self.to_state is None
        ):
            raise ValueError("change point events need a signal and both states")
        if self.kind == "periodic_distance":
            if not self.step or self.step <= 0:
                raise ValueError("periodic distance events need a positive step")
            if not self.signal:
                raise ValueError("periodic distance events need a cumulative signal")

    @property
    def result_type(self) -> str:
        return EVENT_TYPES[self.kind]


@dataclass(frozen=True)
class Histogram1D:
    """``kind``: duration, distance, duration_count (of an event's intervals) or event_count (at an event's points)."""

    name: str
    signal: str | None
    bins: Sequence[float]
    kind: str = "duration"
    event: str | None = None
    weight_signal: str | None = None
    weight_const: float | None = None
    max_duration: int | None = None
    bins_unit: str | None = None
    values_unit: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        check_edges(self.bins)
        if self.kind not in ("duration", "distance", "duration_count", "event_count"):
            raise ValueError(f"unknown histogram kind {self.kind!r}")
        if self.kind == "distance" and not self.weight_signal:
            raise ValueError("a distance histogram needs a cumulative weight signal")
        if self.kind in ("duration_count", "event_count") and not self.event:
            raise ValueError(f"a {self.kind} histogram needs an event")
        if self.kind != "duration_count" and not self.signal:
            raise ValueError(f"a {self.kind} histogram needs a signal")


@dataclass(frozen=True)
class Histogram2D:
    name: str
    x_signal: str
    y_signal: str
    x_bins: Sequence[float]
    y_bins: Sequence[float]
    event: str | None = None
    x_bins_unit: str | None = None
    y_bins_unit: str | None = None
    values_unit: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        check_edges(self.x_bins)
        check_edges(self.y_bins)


@dataclass(frozen=True)
class Statistics:
    name: str
    signals: Sequence[str]
    labels: Sequence[str] = DEFAULT_LABELS
    event: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        if not self.signals:
            raise ValueError("statistics need at least one signal")
        unknown = [label for label in self.labels if label not in LABELS]
        if unknown:
            raise ValueError(f"unknown statistics {unknown}")


@dataclass(frozen=True)
class ReportDefinition:
    name: str
    signals: Sequence[Signal]
    events: Sequence[Event] = ()
    aggregations: Sequence[Histogram1D | Histogram2D | Statistics] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        known = {s.name for s in self.signals}
        events = {e.name: e for e in self.events}
        names = [a.name for a in self.aggregations]
        if len(set(names)) != len(names):
            raise ValueError("aggregation names must be unique")

        def need(signal: str | None) -> None:
            if signal is not None and signal not in known:
                raise ValueError(f"signal {signal!r} does not exist")

        for e in self.events:
            need(e.signal)
            for c in e.conditions:
                need(c.signal)
        for a in self.aggregations:
            refs = {
                Histogram1D: lambda h: [h.signal, h.weight_signal],
                Histogram2D: lambda h: [h.x_signal, h.y_signal],
                Statistics: lambda s: list(s.signals),
            }[type(a)](a)
            for ref in refs:
                need(ref)
            if a.event is None:
                continue
            if a.event not in events:
                raise ValueError(f"event {a.event!r} does not exist")
            points_fit = isinstance(a, Statistics) or (isinstance(a, Histogram1D) and a.kind == "event_count")
            points_only = isinstance(a, Histogram1D) and a.kind == "event_count"
            result = events[a.event].result_type
            if (result == "PointsInTime" and not points_fit) or (result == "Intervals" and points_only):
                raise ValueError(f"event {a.event!r} gives {result}, which does not fit {a.name!r}")

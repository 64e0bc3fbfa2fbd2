"""From a report definition to star-schema tables."""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from copy import copy
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.binning import bin_label, check_edges, with_bin
from seriesloom.operators import histograms as H
from seriesloom.operators.align import locate
from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.series import ID, Intervals, PointsInTime, SampleSeries
from seriesloom.operators.statistics import rows_in_events, summarise
from seriesloom.plans.definitions import Event, Histogram1D, Histogram2D, ReportDefinition, Statistics
from seriesloom.plans.formulas import Formula, Sources, by_support, value_of
from seriesloom.sources.scratch import scratch_folder

_COMPARE = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}

_TEXT = T.StringType()
_EDGES = T.ArrayType(T.DoubleType())


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


HISTOGRAM_DIMENSION = _schema(
    ("visual_id", T.IntegerType()),
    ("name", _TEXT),
    ("agg_type", _TEXT),
    ("description", _TEXT),
    ("bins", _EDGES),
    ("bins_unit", _TEXT),
    ("values_unit", _TEXT),
    ("page_number", T.IntegerType()),
)
HISTOGRAM2D_DIMENSION = _schema(
    ("visual_id", T.IntegerType()),
    ("name", _TEXT),
    ("description", _TEXT),
    ("x_channel_name", _TEXT),
    ("y_channel_name", _TEXT),
    ("x_bins", _EDGES),
    ("y_bins", _EDGES),
    ("x_bins_unit", _TEXT),
    ("y_bins_unit", _TEXT),
    ("values_unit", _TEXT),
)
STATS_DIMENSION = _schema(
    ("visual_id", T.IntegerType()),
    ("name", _TEXT),
    ("description", _TEXT),
    ("channel_names", T.ArrayType(_TEXT)),
    ("statistics", T.ArrayType(_TEXT)),
)
EVENT_DIMENSION = _schema(
    ("event_id", T.IntegerType()),
    ("event_name", _TEXT),
    ("kind", _TEXT),
    ("conditions", _TEXT),
    ("signal", _TEXT),
    ("from_state", T.DoubleType()),
    ("to_state", T.DoubleType()),
    ("step", T.DoubleType()),
)
#: What a histogram definition is to a row: its axes (places in the row's values), edges, weight and longest run.
_WANTED = (
    "array<struct<visual_id: int, x: int, y: int, x_edges: array<double>, y_edges: array<double>, "
    "weight: double, longest: bigint>>"
)


def evaluate_event(event: Event, signals: Mapping[str, SampleSeries]) -> Intervals | PointsInTime:
    """Build the plan of an event over named signals."""
    if event.kind == "change_points":
        return signals[event.signal].change_points(event.from_state, event.to_state)
    if event.kind == "periodic_distance":
        return (signals[event.signal] % float(event.step)).intervals_between_falling_edges()
    parts = [_COMPARE[c.operator](signals[c.signal], float(c.value)) for c in event.conditions]
    joined = reduce(operator.and_ if event.logic == "AND" else operator.or_, parts)
    if event.kind == "rising_edges":
        return joined.rising_edges()
    if event.kind == "falling_edges":
        return joined.falling_edges()
    return joined


class Report:
    """Lazy: signals, events and the rows of signals under events are planned on first use and shared by all aggregations.

    ``channel`` gives the sample series of a physical signal from its tags; virtual signals are formulas over these where
    they are arithmetic. Definitions are data: all that read the same signals under the same event are one array, exploded
    per row, and all of a kind are one aggregation. So the plan grows with the signals and events, not with definitions.

    Signals with more than one consumer are persisted (memory and disk) while ``write`` runs. On a sliced grid, where
    recordings are large and plans deep, each signal, event and alignment is written to ``scratch`` on first use instead and
    read back, which survives lost executors.
    """

    def __init__(
        self,
        spark: SparkSession,
        definition: ReportDefinition,
        channel: Callable[[Mapping[str, str]], SampleSeries],
        sessions: DataFrame | None = None,
        scratch: str | None = None,
    ) -> None:
        self.spark = spark
        self.definition = definition
        self.sessions = sessions
        self._channel = channel
        self._scratch = scratch
        self._sources = Sources(self._settled_frame)
        self._signals: dict[str, SampleSeries] = {}
        self._events: dict[str, Intervals | PointsInTime] = {}
        self._by_name = {s.name: s for s in definition.signals}
        self._event_by_name = {e.name: e for e in definition.events}

    # -- named parts ---------------------------------------------------------------------------------------------
    def signal(self, name: str) -> SampleSeries:
        if name not in self._signals:
            spec = self._by_name[name]
            made = self._channel(spec.channel) if spec.channel is not None else spec.build(_Named(self))
            if not hasattr(made, "eval_type"):
                raise TypeError(f"signal {name!r} is not a series")
            if isinstance(made, SampleSeries) and not self._is_formula(made):
                made = self._sources.add(name, self._settled(f"signal_{name}", made))
            elif not isinstance(made, SampleSeries):
                made = self._settled(f"signal_{name}", made)
            self._signals[name] = made
        return self._signals[name]

    def _is_formula(self, series: object) -> bool:
        return isinstance(series, Formula) and series.sources is self._sources

    def event(self, name: str | None):
        if name is None:
            return None
        if name not in self._events:
            made = evaluate_event(self._event_by_name[name], _Named(self))
            self._events[name] = self._settled(f"event_{name}", made)
        return self._events[name]

    def _mask(self, name: str | None) -> tuple[str, Intervals] | None:
        if name is None:
            return None
        event = self.event(name)
        if not isinstance(event, Intervals):
            raise TypeError("a histogram can only be masked by intervals")
        return name, event

    def _settled(self, name: str, series):
        """The series read back from a written table, where plans would otherwise grow over large recordings."""
        if not series.grid.sliced:
            return series
        back = copy(series)
        back.frame = self._written(name, series.frame)
        return back

    def _settled_frame(self, name: str, frame: DataFrame) -> DataFrame:
        return self._written(name, frame) if self._sources.grid.sliced else frame

    def _written(self, name: str, frame: DataFrame) -> DataFrame:
        if self._scratch is None:
            self._scratch = scratch_folder(self.spark, self.definition.name)
        frame.write.mode("overwrite").parquet(f"{self._scratch}/{name}")
        return self.spark.read.parquet(f"{self._scratch}/{name}")

    def label(self, signal: str) -> str:
        return self._by_name[signal].label or signal

    # -- aggregations --------------------------------------------------------------------------------------------
    def _numbered(self, kind: type) -> list[tuple[int, object]]:
        return [(i, a) for i, a in enumerate(self.definition.aggregations, 1) if isinstance(a, kind)]

    def _values(self, a: Histogram1D | Histogram2D) -> list[Formula]:
        """The signals along the axes of a histogram; none for one of event lengths."""
        names = [a.x_signal, a.y_signal] if isinstance(a, Histogram2D) else [a.signal]
        if isinstance(a, Histogram1D) and a.kind == "duration_count":
            return []
        found = [self.signal(n) for n in names]
        for s in found:
            if not isinstance(s, SampleSeries):
                raise TypeError(f"expected SampleSeries, got {type(s).__name__}")
        return found

    def _rows_of(self, kind: str, values: list[Formula], event: str | None, weight: str | None) -> DataFrame:
        """What histograms of one kind, over the same signals, event and weight signal, count: base values and ``_w``."""
        if kind == "duration_count":
            length = (F.col("tend") - F.col("tstart")).cast("double")
            return self.event(event).frame.select(ID, length.alias("_length"), F.lit(1.0).alias("_w"))
        names = sorted({n for v in values for n in v.names})
        cut = len(names) == 1 and (len(values) > 1 or values[0].cut)
        columns = [value_of(n) for n in names]
        if kind == "event_count":
            points = self.event(event)
            if not isinstance(points, PointsInTime):
                raise TypeError(f"expected PointsInTime, got {type(points).__name__}")
            found = locate(points.frame, self._sources.rows(names, cut), self._sources.grid)
            return found.select(ID, *[F.col(f"run.{c}").alias(c) for c in columns], F.lit(1.0).alias("_w"))
        mask = self._mask(event)
        rows = self._sources.rows(names, cut and mask is None, mask)
        if kind == "distance":
            found = locate(H.increments(self.signal(weight)), rows, self._sources.grid)
            return found.select(ID, *[F.col(f"run.{c}").alias(c) for c in columns], F.col("step").cast("double").alias("_w"))
        return rows.select(ID, *columns, (F.col("tend") - F.col("tstart")).cast("double").alias("_w"))

    def _cells(self, numbered: Sequence[tuple[int, Histogram1D | Histogram2D]]) -> DataFrame:
        """``container_id, visual_id, cell, weight`` of all given histograms; one branch for each set of signals and event."""
        groups: dict[tuple, list[tuple[int, object, list[Formula]]]] = {}
        for number, a in numbered:
            values = self._values(a)
            kind = a.kind if isinstance(a, Histogram1D) else "joint"
            weight = a.weight_signal if kind == "distance" else None
            # which rows a single signal has depends on how often it is cut, see Sources.rows
            names = tuple(sorted({n for v in values for n in v.names}))
            cut = len(names) == 1 and (len(values) > 1 or values[0].cut)
            groups.setdefault((kind, names, cut, a.event, weight), []).append((number, a, values))
        parts, wanted, most = [], [], [0, 0]
        for (kind, _, _, event, weight), members in groups.items():
            columns = [F.col("_length")] if kind == "duration_count" else []
            place: dict[str, int] = {}
            defined = []
            for number, a, values in members:
                for v in values:
                    if str(v.value) not in place:
                        place[str(v.value)] = len(columns)
                        columns.append(v.value)
                two = isinstance(a, Histogram2D)
                edges = [check_edges(e) for e in ([a.x_bins, a.y_bins] if two else [a.bins])]
                most = [max(m, len(e)) for m, e in zip(most, [*edges, []])]
                at = [place[str(v.value)] for v in values] or [0]
                defined.append(
                    {
                        "visual_id": number,
                        **dict(zip("xy", at)),
                        **dict(zip(("x_edges", "y_edges"), edges)),
                        "weight": None if two or kind == "duration" else a.weight_const,
                        "longest": a.max_duration if kind == "duration" else None,
                    }
                )
            rows = self._rows_of(kind, members[0][2], event, weight)
            values = F.array(*[c.cast("double") for c in columns]).alias("_v")
            parts.append(rows.select(ID, F.lit(len(wanted)).alias("_group"), values, "_w"))
            wanted.append(defined)
        cells = _counted(reduce(DataFrame.unionByName, parts), wanted, most)
        return cells.groupBy(ID, "visual_id", "cell").agg(F.sum("weight").alias("weight"))

    def _histograms(self, numbered: Sequence[tuple[int, object]], axes: Sequence[str]) -> DataFrame:
        """Fact rows: every cell of every histogram, for each recording that has rows for it."""
        dims = []
        for number, a in numbered:
            edges = [a.x_bins, a.y_bins] if isinstance(a, Histogram2D) else [a.bins]
            bins = [[(i, lo, hi, bin_label(e, i)) for i, (lo, hi) in enumerate(zip(e, e[1:]))] for e in map(check_edges, edges)]
            dims.append((number, *bins))
        bins = "array<struct<bin_id: int, lower_bound: double, upper_bound: double, bin_name: string>>"
        schema = "visual_id int, " + ", ".join(f"_{i} {bins}" for i in range(len(axes)))
        dims = F.broadcast(self.spark.createDataFrame(dims, schema))  # one row for each definition
        entry = F.when(F.col("cell").isNotNull(), F.struct("cell", F.coalesce("weight", F.lit(0.0))))
        found = self._cells(numbered).groupBy(ID, "visual_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
        size = reduce(lambda a, b: a * b, [F.size(f"_{i}") for i in range(len(axes))])
        rows = found.join(dims, "visual_id").withColumn("_cell", F.explode(F.sequence(F.lit(0), size - 1)))
        index = [F.col("_cell")] if len(axes) == 1 else [
            F.call_function("div", F.col("_cell"), F.size("_1")).cast("int"),
            (F.col("_cell") % F.size("_1")).cast("int"),
        ]
        columns = []
        for i, prefix in enumerate(axes):
            one = F.get(f"_{i}", index[i])
            columns += [one[c].alias(f"{prefix}{c}") for c in ("bin_id", "lower_bound", "upper_bound", "bin_name")]
        value = F.coalesce(F.try_element_at("_found", F.col("_cell")), F.lit(0.0)).alias("hist_value")
        return rows.select("visual_id", ID, *columns, value)

    def _statistics(self, numbered: Sequence[tuple[int, Statistics]]) -> DataFrame:
        """Fact rows of all given statistics; one pass for each event."""
        parts = []
        for event in dict.fromkeys(a.event for _, a in numbered):
            mine = [(i, a) for i, a in numbered if a.event == event]
            names = list(dict.fromkeys(s for _, a in mine for s in a.signals))
            labels = list(dict.fromkeys(label for _, a in mine for label in a.labels))
            formulas = {n: self.signal(n) for n in names}
            for s in formulas.values():
                if not isinstance(s, SampleSeries):
                    raise TypeError(f"expected SampleSeries, got {type(s).__name__}")
            runs = []
            for group in by_support(formulas).values():
                pair = [F.struct(F.lit(n).alias("channel_name"), f.value.alias("value")) for n, f in group.items()]
                rows = next(iter(group.values())).rows().select(ID, "tstart", "tend", F.explode(F.array(*pair)).alias("_s"))
                runs.append(rows.select(ID, "tstart", "tend", "_s.value", "_s.channel_name"))
            runs = reduce(DataFrame.unionByName, runs)
            grid = self._sources.grid
            stats = summarise(rows_in_events(runs, names, self.event(event), grid), labels, grid)
            shown = [(i, s, self.label(s), label) for i, a in mine for s in a.signals for label in a.labels]
            schema = "visual_id int, channel_name string, _label string, aggregation_label string"
            shown = F.broadcast(self.spark.createDataFrame(shown, schema))  # one row for each number asked for
            parts.append(
                stats.join(shown, ["channel_name", "aggregation_label"]).select(
                    "visual_id",
                    ID,
                    "event_instance_id",
                    F.col("_label").alias("channel_name"),
                    "aggregation_label",
                    "statistic_value",
                )
            )
        return reduce(DataFrame.unionByName, parts)

    def facts(self, kind: type, batch: int | None = None) -> Iterator[DataFrame]:
        """Fact rows of one kind, ``batch`` definitions at a time."""
        numbered = self._numbered(kind)
        size = batch or max(1, len(numbered))
        for at in range(0, len(numbered), size):
            some = numbered[at : at + size]
            if kind is Statistics:
                yield self._statistics(some)
            else:
                yield self._histograms(some, ("x_", "y_") if kind is Histogram2D else ("",))

    def dimensions(self) -> dict[str, DataFrame]:
        one, two, stats = [], [], []
        for i, a in self._numbered(Histogram1D):
            bins = [float(b) for b in a.bins]
            one.append((i, a.name, f"histogram_{a.kind}", a.description, bins, a.bins_unit, a.values_unit, 1))
        for i, a in self._numbered(Histogram2D):
            two.append(
                (
                    i,
                    a.name,
                    a.description,
                    self.label(a.x_signal),
                    self.label(a.y_signal),
                    [float(b) for b in a.x_bins],
                    [float(b) for b in a.y_bins],
                    a.x_bins_unit,
                    a.y_bins_unit,
                    a.values_unit,
                )
            )
        for i, a in self._numbered(Statistics):
            stats.append((i, a.name, a.description, [self.label(s) for s in a.signals], list(a.labels)))
        made = {
            "histogram_dimension": (one, HISTOGRAM_DIMENSION),
            "histogram2d_dimension": (two, HISTOGRAM2D_DIMENSION),
            "stats_aggregator_dimension": (stats, STATS_DIMENSION),
        }
        return {n: self.spark.createDataFrame(rows, s) for n, (rows, s) in made.items() if rows}

    def event_dimensions(self) -> dict[str, DataFrame]:
        """One row per defined event, in a table for each type of result."""
        out = {}
        for kind, name in _EVENT_TABLES.items():
            rows = [
                (
                    i,
                    e.name,
                    e.kind,
                    f" {e.logic} ".join(f"{c.signal} {c.operator} {float(c.value):g}" for c in e.conditions),
                    e.signal,
                    None if e.from_state is None else float(e.from_state),
                    None if e.to_state is None else float(e.to_state),
                    None if e.step is None else float(e.step),
                )
                for i, e in enumerate(self.definition.events, 1)
                if e.result_type == kind
            ]
            if rows:
                out[f"{name}_dimension"] = self.spark.createDataFrame(rows, EVENT_DIMENSION)
        return out

    def event_facts(self) -> dict[str, DataFrame]:
        """All event instances: intervals and points."""
        out = {}
        for kind, name in _EVENT_TABLES.items():
            columns = ("tstart", "tend") if kind == "Intervals" else ("t",)
            parts = [
                self.event(e.name)
                .instances()
                .select(F.lit(e.name).alias("event_name"), "container_id", "event_number", "event_instance_id", *columns)
                for e in self.definition.events
                if e.result_type == kind
            ]
            if parts:
                out[f"{name}_fact"] = reduce(DataFrame.unionByName, parts)
        return out

    def constant_tables(self) -> dict[str, DataFrame]:
        """The tables that follow from the definition alone."""
        return {**self.dimensions(), **self.event_dimensions()}

    def fact_tables(self) -> dict[str, DataFrame]:
        """The tables that follow from the recordings."""
        out = {name: next(self.facts(kind)) for name, kind in _FACTS.items() if self._numbered(kind)}
        return {**out, **self.event_facts()}

    def tables(self) -> dict[str, DataFrame]:
        """Every table of the report, by name without prefix."""
        out = {**self.constant_tables(), **self.fact_tables()}
        if self.sessions is not None:
            out["measurement_dimension"] = self.sessions
        return out

    @contextmanager
    def shared(self) -> Iterator[None]:
        """Keep the base signals for several consumers; on a sliced grid they are written tables already."""
        for s in self.definition.signals:
            if s.channel is not None:
                self.signal(s.name)
        kept = [s for s in self._sources.base.values() if not s.grid.sliced]
        for s in kept:
            s.persist()
        try:
            yield
        finally:
            for s in kept:
                s.frame.unpersist()

    def write(self, folder: str, prefix: str | None = None, batch: int = 10_000) -> dict[str, str]:
        """Write all tables as parquet, facts in batches of definitions, and a summary. Returns table name -> path."""
        prefix = prefix or f"{self.definition.name}_report"
        paths = {}
        with self.shared():
            tables = {**self.constant_tables(), **self.event_facts()}
            if self.sessions is not None:
                tables["measurement_dimension"] = self.sessions
            for name, df in tables.items():
                paths[name] = f"{folder}/{prefix}_{name}"
                df.write.mode("overwrite").parquet(paths[name])
            for name, kind in _FACTS.items():
                for number, df in enumerate(self.facts(kind, batch)):
                    paths[name] = f"{folder}/{prefix}_{name}"
                    df.write.mode("append" if number else "overwrite").parquet(paths[name])
        paths["report_summary"] = f"{folder}/{prefix}_report_summary"
        written = {n: self.spark.read.parquet(p) for n, p in paths.items() if n != "report_summary"}
        report_summary(written, self.definition.name).write.mode("overwrite").parquet(paths["report_summary"])
        return paths


def _counted(rows: DataFrame, wanted: Sequence[Sequence[dict]], most: Sequence[int]) -> DataFrame:
    """Rows (ID, _group, values _v, weight _w) counted into the cells of the histograms ``wanted`` of their group:
    ID, visual_id, cell (NULL: outside), weight. ``most``: the largest numbers of edges along x and y.

    The definitions are one literal, whatever their number.
    """
    defined = F.get(F.from_json(F.lit(json.dumps(wanted)), f"array<{_WANTED}>"), F.col("_group"))
    rows = rows.select(ID, "_v", "_w", F.explode(defined).alias("_d")).select(ID, "_d.*", "_v", "_w")
    rows = with_bin(rows, "_x", F.get("_v", F.col("x")), "x_edges", most[0])
    cell = F.col("_x")
    if most[1]:
        rows = with_bin(rows, "_y", F.get("_v", F.col("y")), "y_edges", most[1])
        cell = F.when(F.col("y_edges").isNull(), cell).otherwise(cell * (F.size("y_edges") - 1) + F.col("_y"))
    weight = F.coalesce("weight", F.least("_w", F.col("longest").cast("double")))
    return rows.select(ID, "visual_id", cell.alias("cell"), weight.alias("weight"))


def report_summary(tables: Mapping[str, DataFrame], report: str) -> DataFrame:
    """One row per table of a report: its rows, and its recordings where it has any."""
    parts = []
    for name, df in tables.items():
        recordings = F.count_distinct(ID) if ID in df.columns else F.lit(None).cast("long")
        parts.append(
            df.agg(F.count(F.lit(1)).alias("rows"), recordings.alias("recordings")).select(
                F.lit(report).alias("report"), F.lit(name).alias("table_name"), "rows", "recordings"
            )
        )
    return reduce(DataFrame.unionByName, parts)


#: The tables of events by type of result, and of aggregations.
_EVENT_TABLES = {"Intervals": "interval_event", "PointsInTime": "point_event"}
_FACTS = {
    "histogram_fact": Histogram1D,
    "histogram2d_fact": Histogram2D,
    "stats_aggregator_fact": Statistics,
}


class _Named(Mapping):
    """Signals by name, planned when asked for."""

    def __init__(self, report: Report) -> None:
        self._report = report

    def __getitem__(self, name: str) -> SampleSeries:
        return self._report.signal(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self._report._by_name)

    def __len__(self) -> int:
        return len(self._report._by_name)


def channel_source(runs: DataFrame, find: Callable[..., DataFrame], grid: TimeGrid):
    """A channel lookup for ``Report``: the runs of the channels that ``find`` gives for the tags."""

    def channel(tags: Mapping[str, str]) -> SampleSeries:
        # by recording alone, so that runs that lie by recording stay where they are
        ids = find(**tags).groupBy(ID).agg(F.collect_set("channel_id").alias("_channels"))
        found = runs.join(ids, ID).where(F.array_contains("_channels", F.col("channel_id")))
        return SampleSeries(found, grid)

    return channel


def new_and_changed(silver: DataFrame, gold: DataFrame, changed: str) -> DataFrame:
    """Recordings to process: not in the report yet, or modified since."""
    done = gold.select("container_id", F.col(changed).alias("_done"))
    inserted = silver.join(done, "container_id", "left_anti").withColumn("change", F.lit("inserted"))
    updated = silver.join(done.groupBy("container_id").agg(F.max("_done").alias("_done")), "container_id")
    updated = updated.where(F.col(changed) > F.col("_done")).drop("_done").withColumn("change", F.lit("updated"))
    return inserted.unionByName(updated)


def session_batches(sessions: DataFrame, limit: int, order: Sequence[str]) -> DataFrame:
    """All recordings with the number of their ``batch``: ``limit`` at a time in order of ``order``, which tells them apart.

    Sorted once, by ranges. A recording's place is the number of rows in the ranges before and its place in its own; the
    ranges are as many as shuffle partitions. The result is a written table.
    """
    spark = sessions.sparkSession
    folder = scratch_folder(spark, "sessions")
    sessions.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    batch = F.call_function("div", place, F.lit(limit)).cast("int")
    return rows.join(F.broadcast(sizes), "_range").withColumn("batch", batch).drop("_range", "_before")

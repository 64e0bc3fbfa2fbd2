"""The four series types and their algebra.

Each type wraps one DataFrame (``frame``) holding all recordings at once, keyed by ``container_id``:

* ``SampleSeries``  -- ``tstart, tend, value``: disjoint runs, the value holds over ``[tstart, tend)``
* ``Intervals``     -- ``tstart, tend``
* ``PointsInTime``  -- ``t``
* ``PitSeries``     -- ``t, value``

Operators are lazy and build plans only; a method that a type does not have is an AttributeError while planning.
All times and widths are ticks. Results are per recording: a "scalar" is a DataFrame with one row per recording.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.align import KEY, locate, merge_islands, overlaps
from seriesloom.operators.grid import TimeGrid, spread
from seriesloom.operators.scans import (
    following,
    key_max,
    key_min,
    last_known,
    next_known,
    previous,
    running_count,
    scan,
    step_sums,
)

ID = "container_id"


def _need(other: object, *types: type) -> None:
    if not isinstance(other, types):
        names = " or ".join(t.__name__ for t in types)
        raise TypeError(f"expected {names}, got {type(other).__name__}")


class _Series:
    columns: tuple[str, ...] = ()

    def __init__(self, frame: DataFrame, grid: TimeGrid) -> None:
        missing = [c for c in self.columns if c not in frame.columns]
        if missing:
            raise ValueError(f"{type(self).__name__} needs columns {missing}")
        self.frame = frame.select(*self.columns)
        self.grid = grid

    def eval_type(self) -> str:
        return type(self).__name__

    @classmethod
    def empty(cls, spark: SparkSession, grid: TimeGrid | None = None):
        types = {ID: "bigint", "tstart": "bigint", "tend": "bigint", "t": "bigint", "value": "double"}
        schema = ", ".join(f"{c} {types[c]}" for c in cls.columns)
        return cls(spark.createDataFrame([], schema), grid or TimeGrid())

    def persist(self):
        """Keep the rows for several consumers; memory and disk, so nothing has to fit in memory."""
        self.frame.persist()
        return self

    def _check_grid(self, other: _Series) -> None:
        if self.grid != other.grid:
            raise ValueError("series on different time grids")

    def _scan(self, order: Sequence[str], **scans) -> DataFrame:
        return scan(self.frame, KEY, order, self.grid, order[0], **scans)


class PointsInTime(_Series):
    columns = (ID, "t")

    def expand(self, width: int) -> Intervals:
        """An interval around each point, ``width`` to both sides; overlaps are merged."""
        return self._widen(width, width)

    def expand_left(self, width: int) -> Intervals:
        """Each point becomes the end of an interval."""
        return self._widen(width, 0)

    def expand_right(self, width: int) -> Intervals:
        """Each point becomes the start of an interval."""
        return self._widen(0, width)

    def _widen(self, left: int, right: int) -> Intervals:
        made = self.frame.select(ID, (F.col("t") - left).alias("tstart"), (F.col("t") + right).alias("tend"))
        return Intervals(made, self.grid).merge_overlaps()

    def flipflop(self, reset_points: PointsInTime) -> Intervals:
        """Open at a set point when closed, close at the next reset. A set at the time of a reset is ignored."""
        _need(reset_points, PointsInTime)
        self._check_grid(reset_points)
        sets = self.frame.select(ID, "t", F.lit(1).alias("_set"))
        resets = reset_points.frame.select(ID, "t", F.lit(0).alias("_set"))
        reset_time = F.when(F.col("_set") == 0, F.col("t"))
        rows = scan(
            sets.unionByName(resets),
            KEY,
            ("t", "_set"),
            self.grid,
            "t",
            _held=last_known(reset_time),
            _until=next_known(reset_time),
        )
        opened = rows.where(
            (F.col("_set") == 1) & F.col("_until").isNotNull() & ~F.col("t").eqNullSafe(F.col("_held"))
        )
        made = opened.groupBy(ID, F.col("_until").alias("tend")).agg(F.min("t").alias("tstart"))
        return Intervals(made, self.grid, disjoint=True)

    def filter(self, other: PointsInTime, inverse: bool = False) -> PointsInTime:
        """Points that are (or, inverse, are not) points of ``other`` too."""
        _need(other, PointsInTime)
        how = "left_anti" if inverse else "left_semi"
        return PointsInTime(self.frame.join(other.frame, [ID, "t"], how), self.grid)

    def __and__(self, other: PointsInTime) -> PointsInTime:
        return self.filter(other)

    filter_intersection_left = __and__
    intersection_filter_right = __and__

    def filter_by_distance(self, min_dist: int) -> PointsInTime:
        """Drop points closer than ``min_dist`` to the previous original point."""
        rows = self._scan(("t",), _before=previous(F.col("t")))
        return PointsInTime(
            rows.where(F.col("_before").isNull() | (F.col("t") - F.col("_before") >= min_dist)), self.grid
        )

    def filter_first_intersection(self, obj: Intervals) -> PointsInTime:
        """The first point inside each interval."""
        _need(obj, Intervals)
        self._check_grid(obj)
        inside = locate(self.frame, obj.merge_overlaps().frame, self.grid, closed=False)
        first = inside.groupBy(ID, F.col("run.tstart").alias("_run")).agg(F.min("t").alias("t"))
        return PointsInTime(first, self.grid)

    def delay(self, amount: int) -> PointsInTime:
        return PointsInTime(self.frame.withColumn("t", F.col("t") + amount), self.grid)

    def count(self) -> DataFrame:
        return self.frame.groupBy(ID).agg(F.count(F.lit(1)).alias("value"))

    def instances(self) -> DataFrame:
        """The points with a running number per recording and an id that is the same in every run."""
        return _numbered(self._scan(("t",), event_number=running_count()))

    def between_consecutive(self) -> Intervals:
        """One interval from each point to the next; the stretch after the last point is not one."""
        rows = self._scan(("t",), tend=following(F.col("t")))
        made = rows.where(F.col("tend") > F.col("t")).withColumnRenamed("t", "tstart")
        return Intervals(made, self.grid)


class Intervals(_Series):
    """``disjoint`` says the intervals are known to be merged (no overlaps, none touching)."""

    columns = (ID, "tstart", "tend")

    def __init__(self, frame: DataFrame, grid: TimeGrid, disjoint: bool = False) -> None:
        super().__init__(frame, grid)
        self.disjoint = disjoint

    def merge_overlaps(self) -> Intervals:
        """Union of overlapping and touching intervals; empty ones vanish."""
        if self.disjoint:
            return self
        rows = self.frame.where(F.col("tend") > F.col("tstart"))
        merged = merge_islands(rows, self.grid)
        return Intervals(merged, self.grid, disjoint=True)

    def __and__(self, other: Intervals) -> Intervals:
        _need(other, Intervals)
        self._check_grid(other)
        met = overlaps({"a": self.merge_overlaps().frame, "b": other.merge_overlaps().frame}, self.grid)
        return Intervals(met, self.grid, disjoint=True)

    def __or__(self, other: Intervals) -> Intervals:
        _need(other, Intervals)
        self._check_grid(other)
        return Intervals(self.frame.unionByName(other.frame), self.grid).merge_overlaps()

    def _moved(self, left: int, right: int) -> DataFrame:
        return self.frame.select(
            ID, (F.col("tstart") + left).alias("tstart"), (F.col("tend") + right).alias("tend")
        )

    def expand(self, width: int) -> Intervals:
        return Intervals(self._moved(-width, width), self.grid).merge_overlaps()

    def expand_left(self, width: int) -> Intervals:
        return Intervals(self._moved(-width, 0), self.grid).merge_overlaps()

    def expand_right(self, width: int) -> Intervals:
        return Intervals(self._moved(0, width), self.grid).merge_overlaps()

    def _shrunk(self, left: int, right: int) -> Intervals:
        kept = self._moved(left, -right).where(F.col("tstart") < F.col("tend"))
        return Intervals(kept, self.grid, disjoint=self.disjoint)

    def shrink(self, width: int) -> Intervals:
        return self._shrunk(width, width)

    def shrink_left(self, width: int) -> Intervals:
        return self._shrunk(width, 0)

    def shrink_right(self, width: int) -> Intervals:
        return self._shrunk(0, width)

    def delay(self, amount: int) -> Intervals:
        return Intervals(self._moved(amount, amount), self.grid, disjoint=self.disjoint)

    def _met(self, obj: Intervals | PointsInTime) -> DataFrame:
        """Meetings with ``obj``: the interval as struct ``a`` and the start and end of the common stretch."""
        _need(obj, Intervals, PointsInTime)
        self._check_grid(obj)
        mine = self.merge_overlaps().frame
        if isinstance(obj, Intervals):
            return overlaps({"a": mine, "b": obj.merge_overlaps().frame}, self.grid)
        held = locate(obj.frame, mine, self.grid, closed=False)
        return held.select(
            ID, F.col("t").alias("tstart"), F.col("t").alias("tend"), F.col("run").alias("a"), F.col("t").alias("b")
        )

    def filter(self, obj: Intervals | PointsInTime, inverse: bool = False) -> Intervals:
        """Intervals meeting ``obj``; with ``inverse`` those that do not. Overlapping intervals are merged first."""
        hit = self._met(obj).select(ID, "a.tstart", "a.tend").distinct()
        if inverse:
            hit = self.merge_overlaps().frame.join(hit, [ID, "tstart", "tend"], "left_anti")
        return Intervals(hit, self.grid, disjoint=True)

    def filter_first_intersection(self, obj: Intervals | PointsInTime) -> Intervals:
        """For each interval or point of ``obj`` only the first interval meeting it."""
        first = self._met(obj).groupBy(ID, "b").agg(F.min("a").alias("a")).select(ID, "a.tstart", "a.tend")
        return Intervals(first.distinct(), self.grid, disjoint=True)

    def filter_intersection_left(self, obj: Intervals | PointsInTime) -> Intervals:
        """From each meeting's start to the interval's own end."""
        made = self._met(obj).select(ID, "tstart", F.col("a.tend").alias("tend"))
        return Intervals(made.distinct(), self.grid)

    def filter_intersection_right(self, obj: Intervals | PointsInTime) -> Intervals:
        """From the interval's own start to each meeting's end."""
        made = self._met(obj).select(ID, F.col("a.tstart").alias("tstart"), "tend")
        return Intervals(made.where(F.col("tend") > F.col("tstart")).distinct(), self.grid)

    def start_points(self) -> PointsInTime:
        return PointsInTime(self.frame.select(ID, F.col("tstart").alias("t")), self.grid)

    def end_points(self) -> PointsInTime:
        return PointsInTime(self.frame.select(ID, F.col("tend").alias("t")), self.grid)

    def rising_edges(self) -> PointsInTime:
        return self.start_points()

    def falling_edges(self) -> PointsInTime:
        return self.end_points()

    def starts(self) -> DataFrame:
        return self.frame.select(ID, "tstart")

    def ends(self) -> DataFrame:
        return self.frame.select(ID, "tend")

    def durations(self) -> DataFrame:
        return self.frame.select(ID, "tstart", (F.col("tend") - F.col("tstart")).alias("duration"))

    def summary(self) -> DataFrame:
        """Per recording: number, first start, last end and total duration in ticks and milliseconds."""
        return self.frame.groupBy(ID).agg(
            F.count(F.lit(1)).alias("n_intervals"),
            F.min("tstart").alias("start_time"),
            F.max("tend").alias("end_time"),
            F.sum(F.col("tend") - F.col("tstart")).alias("duration"),
            (self.grid.seconds(F.sum(F.col("tend") - F.col("tstart"))) * 1000).alias("duration_ms"),
        )

    def instances(self) -> DataFrame:
        return _numbered(self._scan(("tstart", "tend"), event_number=running_count()))

    def as_runs(self) -> DataFrame:
        return self.merge_overlaps().frame


class PitSeries(_Series):
    columns = (ID, "t", "value")

    def _agg(self, agg: Column) -> DataFrame:
        return self.frame.groupBy(ID).agg(_nan_if_empty(agg).alias("value"))

    def max(self) -> DataFrame:
        return self._agg(F.max(_number(F.col("value"))))

    def min(self) -> DataFrame:
        return self._agg(F.min(_number(F.col("value"))))

    def abs(self) -> PitSeries:
        return PitSeries(self.frame.withColumn("value", F.abs("value")), self.grid)

    def points(self) -> PointsInTime:
        return PointsInTime(self.frame, self.grid)

    def synchronized(self, other: PitSeries | SampleSeries) -> tuple[PitSeries, PitSeries]:
        """Both at the points they share: equal times, or the points inside a sample series."""
        both = self.joined({"other": other})
        mine = both.select(ID, "t", "value")
        return (
            PitSeries(mine, self.grid),
            PitSeries(both.select(ID, "t", F.col("other").alias("value")), self.grid),
        )

    def joined(self, others: dict[str, PitSeries | SampleSeries]) -> DataFrame:
        """The points with the value of every other series beside them."""
        rows = self.frame
        for name, other in others.items():
            _need(other, PitSeries, SampleSeries)
            self._check_grid(other)
            if isinstance(other, PitSeries):
                rows = rows.join(other.frame.withColumnRenamed("value", name), [ID, "t"])
            else:
                found = locate(rows, other.frame, self.grid)
                rows = found.withColumn(name, F.col("run.value")).drop("run")
        return rows


class SampleSeries(_Series):
    columns = (ID, "tstart", "tend", "value")

    # -- arithmetic ----------------------------------------------------------------------------------------------
    def _map(self, change: Callable[[Column], Column]) -> SampleSeries:
        return SampleSeries(self.frame.withColumn("value", change(F.col("value"))), self.grid)

    def _combine(self, other, op: Callable[[Column, Column], Column]) -> SampleSeries:
        if isinstance(other, (int, float)):
            return self._map(lambda v: op(v, F.lit(float(other))))
        _need(other, SampleSeries)
        both = self.aligned({"b": other}, own="a")
        return SampleSeries(both.withColumn("value", op(F.col("a"), F.col("b"))), self.grid)

    def __add__(self, other):
        return self._combine(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._combine(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._combine(other, lambda a, b: a * b)

    def __truediv__(self, other):
        """Division; the value is NULL where the divisor is 0."""
        return self._combine(other, F.try_divide)

    def __mod__(self, other):
        """Remainder with the sign of the divisor."""
        return self._combine(other, lambda a, b: F.pmod(a, b))

    def __radd__(self, other):
        return self._map(lambda v: F.lit(float(other)) + v)

    def __rsub__(self, other):
        return self._map(lambda v: F.lit(float(other)) - v)

    def __rmul__(self, other):
        return self._map(lambda v: F.lit(float(other)) * v)

    def __rtruediv__(self, other):
        return self._map(lambda v: F.try_divide(F.lit(float(other)), v))

    def abs(self) -> SampleSeries:
        return self._map(F.abs)

    def exp(self) -> SampleSeries:
        return self._map(F.exp)

    # -- comparisons ---------------------------------------------------------------------------------------------
    def _compare(self, other, op: Callable[[Column, Column], Column]) -> Intervals:
        """Merged intervals where the condition holds. NaN and NULL meet no condition."""
        if isinstance(other, (int, float)):
            rows, left, right = self.frame, F.col("value"), F.lit(float(other))
        else:
            _need(other, SampleSeries)
            rows = self.aligned({"b": other}, own="a")
            left, right = F.col("a"), F.col("b")
        holds = op(left, right) & ~F.isnan(left) & ~F.isnan(right)
        return Intervals(rows.where(holds), self.grid).merge_overlaps()

    def __gt__(self, other):
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other):
        return self._compare(other, lambda a, b: a >= b)

    def __lt__(self, other):
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other):
        return self._compare(other, lambda a, b: a <= b)

    def __eq__(self, other):
        return self._compare(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._compare(other, lambda a, b: a != b)

    __hash__ = object.__hash__

    def meeting(self, conditions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
        """``condition, container_id, tstart, tend``: the merged intervals of many named conditions on the value, in one pass.

        As for the comparison operators, NaN and NULL meet no condition.
        """
        v = F.col("value")
        held = [F.when(test(v) & ~F.isnan(v), F.lit(name)) for name, test in conditions.items()]
        rows = self.frame.select(ID, "tstart", "tend", F.explode(F.array_compact(F.array(*held))).alias("condition"))
        rows = rows.where(F.col("tend") > F.col("tstart"))
        return merge_islands(rows, self.grid, (ID, "condition")).select("condition", ID, "tstart", "tend")

    # -- alignment -----------------------------------------------------------------------------------------------
    def aligned(self, others: dict[str, SampleSeries], own: str = "value") -> DataFrame:
        """All series cut at each other's bounds, where all of them exist: one value column per series."""
        for other in others.values():
            _need(other, SampleSeries)
            self._check_grid(other)
        met = overlaps({own: self.frame, **{n: s.frame for n, s in others.items()}}, self.grid)
        return met.select(ID, "tstart", "tend", *[F.col(f"{n}.value").alias(n) for n in (own, *others)])

    def synchronized(self, other: SampleSeries) -> tuple[SampleSeries, SampleSeries]:
        first, second = self.synchronized_all([other])
        return first, second

    def synchronized_all(self, others: Sequence[SampleSeries]) -> list[SampleSeries]:
        """This series and the others, aligned in one pass."""
        names = [f"s{i}" for i in range(1, len(others) + 1)]
        met = self.aligned(dict(zip(names, others)), own="s0")
        return [
            SampleSeries(met.select(ID, "tstart", "tend", F.col(n).alias("value")), self.grid)
            for n in ("s0", *names)
        ]

    def where(self, other: Intervals | PointsInTime) -> SampleSeries | PitSeries:
        """Cut to intervals, or read at points."""
        _need(other, Intervals, PointsInTime)
        self._check_grid(other)
        if isinstance(other, Intervals):
            met = overlaps({"a": self.frame, "b": other.merge_overlaps().frame}, self.grid)
            return SampleSeries(met.withColumn("value", F.col("a.value")), self.grid)
        found = locate(other.frame, self.frame, self.grid)
        return PitSeries(found.withColumn("value", F.col("run.value")), self.grid)

    # -- edges ---------------------------------------------------------------------------------------------------
    def _edges(self, test: Callable[[Column, Column], Column]) -> PointsInTime:
        rows = self._scan(("tstart", "tend"), _before=previous(F.struct("value")))
        before, now = F.col("_before.value"), F.col("value")
        hit = test(before, now) & ~F.isnan(before) & ~F.isnan(now)
        return PointsInTime(rows.where(hit).withColumnRenamed("tstart", "t"), self.grid)

    def rising_edges(self) -> PointsInTime:
        return self._edges(lambda a, b: b > a)

    def falling_edges(self) -> PointsInTime:
        return self._edges(lambda a, b: b < a)

    rising_edge = rising_edges
    falling_edge = falling_edges

    def change_points(self, from_state: float, to_state: float) -> PointsInTime:
        return self._edges(lambda a, b: (a == from_state) & (b == to_state))

    def change_points_from_arbitrary_state_gt(self, to_state: float) -> PointsInTime:
        return self._edges(lambda a, b: (a > to_state) & (b == to_state))

    def change_points_from_arbitrary_state_lt(self, to_state: float) -> PointsInTime:
        return self._edges(lambda a, b: (a < to_state) & (b == to_state))

    def change_points_to_arbitrary_state_gt(self, from_state: float) -> PointsInTime:
        return self._edges(lambda a, b: (a == from_state) & (b > from_state))

    def change_points_to_arbitrary_state_lt(self, from_state: float) -> PointsInTime:
        return self._edges(lambda a, b: (a == from_state) & (b < from_state))

    def intervals_between_falling_edges(self) -> Intervals:
        """Stretches between consecutive falling edges; the pieces before the first and after the last are left out."""
        return self.falling_edges().between_consecutive()

    # -- calculus ------------------------------------------------------------------------------------------------
    def diff(self) -> SampleSeries:
        """Difference to the previous sample; 0 for the first."""
        rows = self._scan(("tstart", "tend"), _before=previous(F.col("value")))
        return SampleSeries(
            rows.withColumn("value", F.coalesce(F.col("value") - F.col("_before"), F.lit(0.0))), self.grid
        )

    def _running(self, **steps: Callable[[Column, Column], Column]) -> DataFrame:
        return step_sums(
            self.frame, KEY, ("tstart", "tend"), self.grid, "tstart", ("tstart", "tend", "value"), **steps
        )

    def cumtrapz(self, cum_across_uncontinuous_intervals: bool = True) -> SampleSeries:
        """Running integral over ticks by the trapezoidal rule. With False it starts anew after every gap."""
        if cum_across_uncontinuous_intervals:
            return SampleSeries(self._running(_sum=_trapezoid).withColumn("value", F.col("_sum")), self.grid)
        rows = self._running(_part=_gap)
        rows = step_sums(
            rows,
            (*KEY, "_part"),
            ("tstart", "tend"),
            self.grid,
            "tstart",
            ("tstart", "tend", "value"),
            _sum=_trapezoid,
        )
        return SampleSeries(rows.withColumn("value", F.col("_sum")), self.grid)

    def trapz(self) -> DataFrame:
        """Integral over the whole recording, in value x ticks."""
        rows = self._scan(("tstart", "tend"), _before=previous(F.struct("tstart", "tend", "value")))
        area = _trapezoid(F.col("_before"), F.struct("tstart", "tend", "value"))
        return rows.groupBy(ID).agg(F.sum(F.coalesce(area, F.lit(0.0))).alias("value"))

    def continuity(self) -> DataFrame:
        """The runs with the number of gaps before them."""
        return self._running(part=_gap)

    def resample(self, sample_rate: int, interp_kind: str = "previous") -> SampleSeries:
        """Values on the grid start, start + rate, ... up to the end of the recording, each held until the next.

        A grid point inside a gap has no value and is left out. Each run makes the points it holds itself, in blocks, so
        nothing is aligned and the points of a long run are spread over many tasks.
        """
        if interp_kind != "previous":
            raise ValueError("only 'previous' interpolation is defined")
        if sample_rate <= 0:
            raise ValueError("sample_rate must be positive")
        step, block = int(sample_rate), 4096
        runs = self._scan(
            ("tstart", "tend"),
            _next=following(F.col("tstart")),
            _lo=key_min(F.col("tstart")),
            _hi=key_max(F.col("tend")),
        )
        # a run holds its own end point when no run starts there
        until = F.least(F.col("tend"), F.col("_next") - 1)
        first = F.call_function("div", F.col("tstart") - F.col("_lo") + (step - 1), F.lit(step))
        last = F.call_function("div", until - F.col("_lo"), F.lit(step))
        runs = runs.withColumn("_first", first).withColumn("_last", last)
        runs = runs.where((F.col("_first") <= F.col("_last")) & (F.col("tstart") <= until))
        steps = F.sequence(F.col("_first"), F.col("_last"), F.lit(block).cast("long"))
        blocks = runs.select(ID, "value", "_lo", "_hi", "_last", F.explode(steps).alias("_i"))
        index = F.explode(F.sequence(F.col("_i"), F.least(F.col("_i") + block - 1, F.col("_last"))))
        points = spread(blocks, ID, "_i").select(ID, "value", "_lo", "_hi", index.alias("_i"))
        t = F.col("_lo") + F.col("_i") * step
        return SampleSeries(
            points.select(ID, t.alias("tstart"), F.least(t + step, F.col("_hi")).alias("tend"), "value"), self.grid
        )

    # -- aggregates ----------------------------------------------------------------------------------------------
    def max(self) -> DataFrame:
        return self._scalar(F.max(_number(F.col("value"))))

    def min(self) -> DataFrame:
        return self._scalar(F.min(_number(F.col("value"))))

    def mean(self) -> DataFrame:
        """Mean weighted by run length; NaN if nothing has a length."""
        return self._scalar(_weighted_mean(F.col("value"), _length()))

    def sum(self) -> DataFrame:
        """Sum of value x run length."""
        return self._scalar(F.sum(_number(F.col("value")) * _length()))

    def _scalar(self, agg: Column) -> DataFrame:
        return self.frame.groupBy(ID).agg(_nan_if_empty(agg).alias("value"))

    def scalars(self) -> DataFrame:
        """All four scalars in one pass."""
        v = _number(F.col("value"))
        return self.frame.groupBy(ID).agg(
            _nan_if_empty(F.max(v)).alias("max"),
            _nan_if_empty(F.min(v)).alias("min"),
            _nan_if_empty(_weighted_mean(F.col("value"), _length())).alias("mean"),
            _nan_if_empty(F.sum(v * _length())).alias("sum"),
        )

    def metadata(self) -> DataFrame:
        """Sample count and rate (per second), duration in ms, first start, last end and share of NaN."""
        n = F.count(F.lit(1))
        span = F.max("tend") - F.min("tstart")
        return self.frame.groupBy(ID).agg(
            n.alias("sample_count"),
            F.try_divide(n, self.grid.seconds(span)).alias("sample_rate"),
            (self.grid.seconds(F.sum(_length())) * 1000).alias("duration_ms"),
            F.min("tstart").alias("start_time"),
            F.max("tend").alias("end_time"),
            F.avg(F.coalesce(F.isnan("value"), F.lit(False)).cast("double")).alias("nan_ratio"),
        )

    def durations(self) -> DataFrame:
        return self.frame.select(ID, "tstart", _length().alias("duration"))

    def _within(self, intervals: Intervals, agg: Callable[[Column, Column], Column]) -> SampleSeries:
        _need(intervals, Intervals)
        self._check_grid(intervals)
        met = overlaps({"a": self.frame, "b": intervals.merge_overlaps().frame}, self.grid)
        rows = met.groupBy(ID, "b.tstart", "b.tend").agg(
            _nan_if_empty(agg(_number(F.col("a.value")), F.col("tend") - F.col("tstart"))).alias("value")
        )
        return SampleSeries(rows, self.grid)

    def within_intervals(self, intervals: Intervals) -> DataFrame:
        """Largest, smallest and mean value (weighted by length) in each interval, from one alignment."""
        _need(intervals, Intervals)
        self._check_grid(intervals)
        met = overlaps({"a": self.frame, "b": intervals.merge_overlaps().frame}, self.grid)
        v = _number(F.col("a.value"))
        return met.groupBy(ID, "b.tstart", "b.tend").agg(
            _nan_if_empty(F.max(v)).alias("max"),
            _nan_if_empty(F.min(v)).alias("min"),
            _nan_if_empty(_weighted_mean(v, _length())).alias("mean"),
        )

    def max_within_intervals(self, intervals: Intervals) -> SampleSeries:
        return self._within(intervals, lambda v, d: F.max(v))

    def min_within_intervals(self, intervals: Intervals) -> SampleSeries:
        return self._within(intervals, lambda v, d: F.min(v))

    def mean_within_intervals(self, intervals: Intervals) -> SampleSeries:
        return self._within(intervals, _weighted_mean)


def _trapezoid(before: Column, now: Column) -> Column:
    return (now["value"] + before["value"]) / 2 * (now["tstart"] - before["tstart"])


def _gap(before: Column, now: Column) -> Column:
    return (before["tend"] < now["tstart"]).cast("long")


def _length() -> Column:
    return F.col("tend") - F.col("tstart")


def _number(v: Column) -> Column:
    """NaN as NULL, which aggregates skip."""
    return F.when(~F.isnan(v), v)


def _nan_if_empty(agg: Column) -> Column:
    return F.coalesce(agg, F.lit(float("nan")))


def _weighted_mean(value: Column, weight: Column) -> Column:
    v = _number(value)
    return F.try_divide(F.sum(v * weight), F.sum(F.when(v.isNotNull(), weight)))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_instance_id", F.xxhash64(ID, "event_number"))

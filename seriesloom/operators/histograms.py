"""Histograms per recording, as star-schema fact rows.

Every histogram is one partial aggregation by (recording, cell); rows outside the edges keep the recording alive through
a NULL cell. Then each recording's few cells are filled up with zeros. What is gathered per recording is bounded by the
number of cells of the definition, never by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.binning import bin_index, bin_label, check_edges
from seriesloom.operators.align import locate, overlaps
from seriesloom.operators.series import ID, Intervals, PitSeries, PointsInTime, SampleSeries


def _axis(prefix: str, edges: Sequence[float], index: Column) -> list[Column]:
    """The bin columns of one axis, looked up by bin index."""
    edges = check_edges(edges)
    n = len(edges) - 1

    def pick(values: Sequence) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), index)

    return [
        index.cast("int").alias(f"{prefix}bin_id"),
        pick(edges[:-1]).alias(f"{prefix}lower_bound"),
        pick(edges[1:]).alias(f"{prefix}upper_bound"),
        pick([bin_label(edges, i) for i in range(n)]).alias(f"{prefix}bin_name"),
    ]


def binned(
    rows: DataFrame,
    weight: Column,
    axes: Mapping[str, tuple[Column, Sequence[float]]],
) -> DataFrame:
    """Sum ``weight`` per recording and cell. ``axes`` maps a column prefix to (value, edges)."""
    sizes = [len(check_edges(edges)) - 1 for _, edges in axes.values()]
    cell = F.lit(0)
    for (value, edges), size in zip(axes.values(), sizes):
        cell = cell * size + bin_index(value, edges)
    n_cells = 1
    for size in sizes:
        n_cells *= size

    sums = rows.select(ID, cell.alias("_cell"), weight.cast("double").alias("_w")).groupBy(ID, "_cell").agg(
        F.sum("_w").alias("_w")
    )
    entry = F.when(F.col("_cell").isNotNull(), F.struct("_cell", F.coalesce("_w", F.lit(0.0)).alias("_w")))
    per_id = sums.groupBy(ID).agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    filled = per_id.select(
        ID, "_cells", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("_cell")
    )
    columns: list[Column] = []
    stride = n_cells
    for (prefix, (_, edges)), size in zip(axes.items(), sizes):
        stride //= size
        index = F.pmod(F.call_function("div", F.col("_cell"), F.lit(stride)), F.lit(size)).cast("int")
        columns += _axis(prefix, edges, index)
    return filled.select(
        ID, *columns, F.coalesce(F.try_element_at("_cells", F.col("_cell")), F.lit(0.0)).alias("hist_value")
    )


def _masked(series: SampleSeries, event: Intervals | None) -> SampleSeries:
    if event is None:
        return series
    if not isinstance(event, Intervals):
        raise TypeError("a histogram can only be masked by intervals")
    return series.where(event)


def _length(max_duration: int | None) -> Column:
    length = F.col("tend") - F.col("tstart")
    return length if max_duration is None else F.least(length, F.lit(int(max_duration)))


def duration_histogram(
    series: SampleSeries,
    bins: Sequence[float],
    event: Intervals | None = None,
    max_duration: int | None = None,
) -> DataFrame:
    """Ticks spent in each bin. ``max_duration`` caps the length counted for one run."""
    _expect(series, SampleSeries)
    rows = _masked(series, event).frame
    return binned(rows, _length(max_duration), {"": (F.col("value"), bins)})


def increments(weight: SampleSeries) -> DataFrame:
    """Growth of a cumulative signal: ``t`` when it is reached, and the ``step``."""
    _expect(weight, SampleSeries)
    return weight.diff().frame.select(ID, F.col("tstart").alias("t"), F.col("value").alias("step"))


def distance_histogram(
    series: SampleSeries,
    weight: SampleSeries,
    bins: Sequence[float],
    event: Intervals | None = None,
    weight_const: float | None = None,
) -> DataFrame:
    """Growth of a cumulative signal (e.g. odometer) while the series is in each bin.

    The increments are taken on the weight's own samples, so no growth is counted twice when the series changes between
    two of them; an increment belongs to the bin the series is in when the increment is reached.
    """
    _expect(series, SampleSeries)
    if weight is None:
        raise TypeError("a distance histogram needs a cumulative weight signal")
    rows = locate(increments(weight), _masked(series, event).frame, series.grid)
    amount = F.col("step") if weight_const is None else F.lit(float(weight_const))
    return binned(rows, amount, {"": (F.col("run.value"), bins)})


def duration_count_histogram(
    intervals: Intervals, bins: Sequence[float], weight_const: float = 1.0
) -> DataFrame:
    """Number of intervals per length bin (ticks)."""
    _expect(intervals, Intervals)
    length = (F.col("tend") - F.col("tstart")).cast("double")
    return binned(intervals.frame, F.lit(float(weight_const)), {"": (length, bins)})


def event_count_histogram(
    series: SampleSeries, points: PointsInTime, bins: Sequence[float], weight_const: float = 1.0
) -> DataFrame:
    """Number of event points per bin of the series' value at the point."""
    _expect(series, SampleSeries)
    _expect(points, PointsInTime)
    return pit_histogram(series.where(points), bins, weight_const)


def pit_histogram(pits: PitSeries, bins: Sequence[float], weight_const: float = 1.0) -> DataFrame:
    """Number of points per bin of their value."""
    _expect(pits, PitSeries)
    return binned(pits.frame, F.lit(float(weight_const)), {"": (F.col("value"), bins)})


_PREFIXES = ("x_", "y_", "z_")


def joint_histogram(
    series: Sequence[SampleSeries],
    bins: Sequence[Sequence[float]],
    event: Intervals | None = None,
    max_duration: int | None = None,
) -> DataFrame:
    """Ticks for which 2 (or 3) series are in a cell together. One alignment pass for all series and the event."""
    if not 2 <= len(series) <= 3 or len(bins) != len(series):
        raise ValueError("two or three series, each with its bins")
    for s in series:
        _expect(s, SampleSeries)
        series[0]._check_grid(s)
    sources = {f"s{i}": s.frame for i, s in enumerate(series)}
    if event is not None:
        _expect(event, Intervals)
        sources["event"] = event.merge_overlaps().frame
    rows = overlaps(sources, series[0].grid)
    axes = {p: (F.col(f"s{i}.value"), b) for i, (p, b) in enumerate(zip(_PREFIXES, bins))}
    return binned(rows, _length(max_duration), axes)


def joint_pit_histogram(
    pits: PitSeries,
    others: Sequence[PitSeries | SampleSeries],
    bins: Sequence[Sequence[float]],
    weight_const: float = 1.0,
) -> DataFrame:
    """Number of points per cell of their value and the values of other series at them."""
    _expect(pits, PitSeries)
    names = [f"o{i}" for i in range(len(others))]
    rows = pits.joined(dict(zip(names, others)))
    values = ["value", *names]
    axes = {p: (F.col(v), b) for p, v, b in zip(_PREFIXES, values, bins)}
    return binned(rows, F.lit(float(weight_const)), axes)


def _expect(value: object, kind: type) -> None:
    if not isinstance(value, kind):
        raise TypeError(f"expected {kind.__name__}, got {type(value).__name__}")

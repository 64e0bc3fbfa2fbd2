"""Statistics per event instance, in long rows (recording, instance, channel, label, value)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.align import locate, overlaps
from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.series import ID, Intervals, PitSeries, PointsInTime, SampleSeries

#: The labels a statistics definition may ask for, and those it gets when it names none.
LABELS = ("min", "max", "mean", "median", "std", "count")
DEFAULT_LABELS = ("min", "max", "mean", "median")

#: Parts a large group is joined in.
SALTS = 16

GROUP = (ID, "event_instance_id", "channel_name")


def _with_totals(rows: DataFrame, keys: Sequence[str], weight: str, count: str) -> DataFrame:
    """Cumulative and total weight and count along ``value``."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "*",
        F.sum(weight).over(upto).alias("cw"),
        F.sum(count).over(upto).alias("cn"),
        F.sum(weight).over(w).alias("tw"),
        F.sum(count).over(w).alias("tn"),
    )


def weighted_median(rows: DataFrame, keys: Sequence[str], pieces: int = 256) -> DataFrame:
    """Smallest ``value`` whose cumulative ``weight`` reaches half of the total; by count when all weights are 0.

    For groups too large for one task. Equal values are added up first; the distinct values are cut into pieces at
    approximate quantiles, the piece holding the middle is found from the piece totals, and only that piece is put in
    order. The cuts are joined by group and a salt of the value, so that no task gets a whole group. The result is exact.
    """
    by_value = (
        rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*keys, "value")
        .agg(F.sum(F.coalesce("weight", F.lit(0))).alias("w"), F.count(F.lit(1)).alias("n"))
    )
    cuts = [i / pieces for i in range(1, pieces)]
    edges = by_value.groupBy(*keys).agg(F.percentile_approx("value", cuts, 1000).alias("_edges"))
    edges = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = by_value.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    placed = salted.join(edges, [*keys, "_salt"]).select(
        *keys, "value", "w", "n", F.size(F.filter("_edges", lambda e: e <= F.col("value"))).alias("_piece")
    )
    totals = placed.groupBy(*keys, "_piece").agg(F.sum("w").alias("pw"), F.sum("n").alias("pn"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = totals.select(
        *keys,
        "_piece",
        "pw",
        "pn",
        F.coalesce(F.sum("pw").over(before), zero).alias("bw"),
        F.coalesce(F.sum("pn").over(before), zero).alias("bn"),
        F.sum("pw").over(w).alias("tw"),
        F.sum("pn").over(w).alias("tn"),
    )
    middle = totals.withColumn("cw", F.col("bw") + F.col("pw")).withColumn("cn", F.col("bn") + F.col("pn"))
    middle = middle.where(_reached()).groupBy(*keys).agg(
        F.min(F.struct("_piece", "bw", "bn", "tw", "tn")).alias("m")
    )
    inner = placed.join(middle.select(*keys, "m.*"), [*keys, "_piece"])
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("cw", F.col("bw") + F.sum("w").over(upto)).withColumn(
        "cn", F.col("bn") + F.sum("n").over(upto)
    )
    return inner.where(_reached()).groupBy(*keys).agg(F.min("value").alias("median"))


def _reached():
    by_weight = F.col("cw") * 2 >= F.col("tw")
    by_count = F.col("cn") * 2 >= F.col("tn")
    return F.when(F.col("tw") > 0, by_weight).otherwise(by_count)


def _long(series: Mapping[str, SampleSeries]) -> DataFrame:
    rows = None
    for name, s in series.items():
        part = s.frame.withColumn("channel_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def event_rows(
    series: Mapping[str, SampleSeries], event: Intervals | PointsInTime | None
) -> DataFrame:
    """What the statistics run over: (recording, instance, channel, value, weight)."""
    if not series:
        raise ValueError("statistics need at least one signal")
    for s in series.values():
        if not isinstance(s, SampleSeries):
            raise TypeError(f"expected SampleSeries, got {type(s).__name__}")
    return rows_in_events(_long(series), list(series), event, next(iter(series.values())).grid)


def rows_in_events(
    rows: DataFrame, channels: Sequence[str], event: Intervals | PointsInTime | None, grid: TimeGrid
) -> DataFrame:
    """``event_rows`` of runs that carry their ``channel_name`` (one of ``channels``) already."""
    if event is None:
        return rows.select(
            ID,
            F.xxhash64(ID, F.lit(1).cast("long")).alias("event_instance_id"),
            "channel_name",
            "value",
            (F.col("tend") - F.col("tstart")).alias("weight"),
        )
    keys = (ID, "channel_name")
    names = F.explode(F.array(*[F.lit(n) for n in channels])).alias("channel_name")
    if isinstance(event, Intervals):
        found = event.merge_overlaps().instances()
        found = found.select(ID, "tstart", "tend", "event_instance_id", names)
        met = overlaps({"a": rows, "b": found}, grid, keys)
        return met.select(
            ID,
            F.col("b.event_instance_id").alias("event_instance_id"),
            "channel_name",
            F.col("a.value").alias("value"),
            (F.col("tend") - F.col("tstart")).alias("weight"),
        )
    if isinstance(event, PointsInTime):
        found = event.instances().select(ID, "t", "event_instance_id", names)
        held = locate(found, rows, grid, keys)
        return held.select(
            ID,
            "event_instance_id",
            "channel_name",
            F.col("run.value").alias("value"),
            F.lit(1).cast("long").alias("weight"),
        )
    raise TypeError(f"expected Intervals or PointsInTime, got {type(event).__name__}")


def _mean(value: Column, weight: Column, agg: Callable[[Column], Column] = lambda c: c) -> Column:
    """Weighted mean; the plain one when all weights are 0."""
    weighted = F.try_divide(agg(F.sum(value * weight)), agg(F.sum(weight)))
    return F.coalesce(weighted, agg(F.avg(value)))


def summarise(rows: DataFrame, labels: Sequence[str], grid: TimeGrid, keys: Sequence[str] = GROUP) -> DataFrame:
    """Long statistics of (keys, value, weight) rows. Every group has a row for each label.

    NaN and NULL values count for ``count`` only; their weight counts for nothing. A value without a weight has weight 0.
    Rows with a NULL key are left out. The standard deviation takes the mean first and then the squares around it.
    """
    unknown = [label for label in labels if label not in LABELS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}")
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    number = F.when(~F.isnan("value"), F.col("value"))
    rows = rows.select(*keys, number.alias("value"), F.when(number.isNotNull(), F.coalesce("weight", F.lit(0))).alias("weight"))
    v, weight = F.col("value"), F.col("weight")
    around = (v - F.col("_mean")) * (v - F.col("_mean"))
    simple = {
        "min": F.min(v),
        "max": F.max(v),
        "mean": _mean(v, weight),
        "std": F.sqrt(_mean(around, weight)),
        "count": F.count(F.lit(1)).cast("double"),
    }
    small, large = grid.parts(rows)
    parts = []
    if small is not None:
        parts.append(_in_windows(small, labels, keys, simple))
    if large is not None:
        parts.append(_in_pieces(large, labels, keys, simple))
    wide = reduce(DataFrame.unionByName, parts)
    return wide.unpivot(list(keys), list(labels), "aggregation_label", "statistic_value")


def _in_windows(rows: DataFrame, labels: Sequence[str], keys: Sequence[str], simple: Mapping[str, Column]) -> DataFrame:
    """Groups fit into a task: mean and median come from windows over the same groups, all in one shuffle."""
    v, weight, columns = F.col("value"), F.col("weight"), dict(simple)
    if "std" in labels:
        whole = Window.partitionBy(*keys)
        rows = rows.withColumn("_mean", _mean(v, weight, lambda c: c.over(whole)))
    if "median" in labels:
        rows = _with_totals(rows.withColumn("_n", v.isNotNull().cast("long")), keys, "weight", "_n")
        columns["median"] = F.min(F.when(_reached(), v))
    return rows.groupBy(*keys).agg(*[columns[label].alias(label) for label in labels])


def _in_pieces(rows: DataFrame, labels: Sequence[str], keys: Sequence[str], simple: Mapping[str, Column]) -> DataFrame:
    """Groups of large recordings: nothing but sums reaches one task."""
    source = rows
    if "std" in labels:
        source = rows.join(rows.groupBy(*keys).agg(_mean(F.col("value"), F.col("weight")).alias("_mean")), list(keys))
    wanted = [label for label in labels if label != "median"]
    wide = source.groupBy(*keys).agg(*[simple[label].alias(label) for label in wanted or ["count"]])
    if "median" in labels:
        wide = wide.join(weighted_median(rows, keys), list(keys), "left")
    return wide.select(*keys, *labels)


def event_statistics(
    series: Mapping[str, SampleSeries],
    event: Intervals | PointsInTime | None = None,
    labels: Sequence[str] = DEFAULT_LABELS,
) -> DataFrame:
    """Statistics of each signal in each event instance; without an event, over each whole recording."""
    grid = next(iter(series.values())).grid
    return summarise(event_rows(series, event), labels, grid)


def typed_statistics(
    operand: SampleSeries | Intervals | PointsInTime | PitSeries, labels: Sequence[str] = DEFAULT_LABELS
) -> DataFrame:
    """Statistics per recording by type: run values, interval lengths, number of points, point values."""
    one = F.lit(1).cast("long").alias("weight")
    f = operand.frame
    if isinstance(operand, SampleSeries):
        rows = f.select(ID, "value", (F.col("tend") - F.col("tstart")).alias("weight"))
    elif isinstance(operand, Intervals):
        rows = f.select(ID, (F.col("tend") - F.col("tstart")).cast("double").alias("value"), one)
    elif isinstance(operand, PitSeries):
        rows = f.select(ID, "value", one)
    elif isinstance(operand, PointsInTime):
        rows, labels = f.select(ID, F.lit(1.0).alias("value"), one), ("count",)
    else:
        raise TypeError(f"no statistics for {type(operand).__name__}")
    return summarise(rows, labels, operand.grid, (ID,))

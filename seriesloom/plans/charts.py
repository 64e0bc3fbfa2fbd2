"""Tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: names taken for a running distance.
DISTANCE_NAME = r"(?i)distance|odometer|odo|km"


def default_x_channel(channels: DataFrame, name: str = "channel_name", order: str = "position") -> DataFrame:
    """The first channel that looks like a distance, else the first one."""
    ranked = channels.select(name, F.struct(~F.col(name).rlike(DISTANCE_NAME), F.col(order)).alias("_rank"))
    return ranked.agg(F.min_by(name, "_rank").alias("x_channel"))


def statistics_over(fact: DataFrame, x_channel: str, labels: Sequence[str]) -> DataFrame:
    """Statistics of the other channels per event instance, over the x channel's value in that instance.

    x is the first of min, mean, median, max that exists.
    """
    keys = ["visual_id", "event_instance_id"]
    x_labels = ["min", "mean", "median", "max"]
    wide = (
        fact.groupBy(*keys, "channel_name")
        .pivot("aggregation_label", sorted({*labels, *x_labels}))
        .agg(F.first("statistic_value"))
    )
    xs = wide.where(F.col("channel_name") == x_channel).select(*keys, F.coalesce(*x_labels).alias("x"))
    ys = wide.where(F.col("channel_name") != x_channel).select(*keys, "channel_name", *labels)
    return ys.join(xs.where(F.col("x").isNotNull()), keys).orderBy("channel_name", "x")


def assign_axes(signals: DataFrame) -> DataFrame:
    """Left or right axis per signal (``channel_id, unit, min_value, max_value``).

    One unit: all left. Two units: the one with more signals left. Three or more: units in the order of their mean
    mid-range, all left but the last. Ties go to the unit whose first signal comes first.
    """
    unit = F.when(F.coalesce("unit", F.lit("")) == "", F.lit("value")).otherwise(F.col("unit"))
    rows = signals.withColumn("unit", unit)
    mid = (F.coalesce("min_value", F.lit(0.0)) + F.coalesce("max_value", F.lit(0.0))) / 2
    units = rows.groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg(mid).alias("mid"), F.min("channel_id").alias("first")
    )
    # One row per unit of the selected signals: as small as the list of units of measure.
    all_units = Window.partitionBy(F.lit(1))
    ranked = units.select(
        "unit",
        F.count(F.lit(1)).over(all_units).alias("n_units"),
        F.row_number().over(all_units.orderBy(F.desc("n"), "first")).alias("by_size"),
        F.row_number().over(all_units.orderBy("mid", "first")).alias("by_mid"),
    )
    right = F.when(F.col("n_units") == 2, F.col("by_size") == 2).when(
        F.col("n_units") > 2, F.col("by_mid") == F.col("n_units")
    )
    side = F.when(F.coalesce(right, F.lit(False)), F.lit("right")).otherwise(F.lit("left"))
    return rows.join(ranked, "unit").select("channel_id", "unit", side.alias("axis"))

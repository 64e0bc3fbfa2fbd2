"""Metrics and tags of channels and recordings, derived from the samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.tags import base_name, dir_name
from seriesloom.functions.times import timestamp_of

CHANNEL = ("container_id", "channel_id")


def channel_metrics(samples: DataFrame, ticks_per_second: int) -> DataFrame:
    """Count, range, plain mean, time bounds, duration and rate per channel."""
    n = F.count(F.lit(1))
    begin, end = F.min("time"), F.max("time")
    return samples.groupBy(*CHANNEL).agg(
        n.cast("int").alias("sample_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        begin.alias("begin_ticks"),
        end.alias("end_ticks"),
        (end - begin).alias("duration_ticks"),
        F.try_divide(n, (end - begin) / F.lit(float(ticks_per_second))).alias("sample_rate"),
        F.lit("DOUBLE").alias("value_type"),
    )


def channel_tags(samples: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Key/value rows of the tag columns; the smallest value where a channel has several, so reruns agree.

    The distinct tag sets come first: that aggregation works on hashes, where the smallest of strings needs a sort.
    """
    sets = samples.select(*CHANNEL, *[F.col(t).cast("string").alias(t) for t in tags]).distinct()
    firsts = sets.groupBy(*CHANNEL).agg(*[F.min(t).alias(t) for t in tags])
    return firsts.unpivot(list(CHANNEL), list(tags), "key", "value")


def container_metrics(samples: DataFrame, ticks_per_second: int, vehicle: str = "vehicle_key") -> DataFrame:
    """Vehicle, start, stop, duration and number of channels per recording, all from its samples.

    The channels are brought to one row each first, so that a large recording is spread over its channels.
    """
    per_channel = samples.groupBy(*CHANNEL, F.col(vehicle).alias("vehicle_key")).agg(
        F.min("time").alias("lo"), F.max("time").alias("hi")
    )
    per = per_channel.groupBy("container_id").agg(
        F.min("vehicle_key").alias("vehicle_key"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.countDistinct("channel_id").cast("int").alias("num_channels"),
    )
    start, stop = timestamp_of(F.col("lo"), ticks_per_second), timestamp_of(F.col("hi"), ticks_per_second)
    return per.select(
        "container_id",
        "vehicle_key",
        F.unix_millis(start).alias("start_ts"),
        F.unix_millis(stop).alias("stop_ts"),
        start.alias("start_dt"),
        stop.alias("stop_dt"),
        (F.unix_millis(stop) - F.unix_millis(start)).alias("duration_ms"),
        "num_channels",
    )


def path_tags(files: DataFrame, path: str = "filename", size: str | None = None) -> DataFrame:
    """Key/value rows from the file path: uri, folder, name and, if known, size in MB."""
    p = F.col(path)
    tags = {"file_uri": p, "base_uri": dir_name(p), "filename": base_name(p)}
    if size:
        tags["filesize_mb"] = (F.col(size) / 1024 / 1024).cast("string")
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in tags.items()]
    return files.select("container_id", F.explode(F.array(*pairs)).alias("_t")).select(
        "container_id", "_t.key", "_t.value"
    )


def plausible(samples: DataFrame, ranges: DataFrame, name: str = "channel_name") -> DataFrame:
    """Drop values outside the range known for their channel (``lo``, ``hi``); channels without a range stay."""
    rows = samples.join(ranges.select(name, "lo", "hi"), name, "left")
    kept = F.col("lo").isNull() | F.col("value").between(F.col("lo"), F.col("hi"))
    return rows.where(kept).drop("lo", "hi")


def valid_numbers(samples: DataFrame, raw: str = "raw", invalid: str = "invalid") -> DataFrame:
    """Texts to numbers: samples of non-numeric channels go, invalidated ones become NaN."""
    number = F.expr(f"try_cast({raw} AS double)")
    return samples.withColumn(
        "value", F.when(F.col(invalid) & number.isNotNull(), F.lit(float("nan"))).otherwise(number)
    ).where(F.col("value").isNotNull()).drop(raw, invalid)

"""From recording files to samples: what is in them, who reads what, and the reading itself."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.tags import COMMENT_KEYS, comment_tags, signal_name, signal_unit
from seriesloom.functions.times import ticks_of
from seriesloom.operators.grid import TimeGrid, spread
from seriesloom.operators.scans import key_max, scan
from seriesloom.sources.recording_source import ORDER, Decoder, read_tasks

CHANNELS = "filename string, group_idx int, channel_idx int, channel_name string, unit string, sample_count bigint, comment string"

#: A file reader gives the channels of a file, one dict per channel with the columns of ``CHANNELS`` but the file name;
#: ``comment`` (a dict as text) may be left out. It should read no more of the file than it must: headers, not samples.
Enumerator = Callable[[str], Iterable[dict]]


def list_channels(files: DataFrame, enumerate_file: Enumerator, min_samples: int = 0) -> DataFrame:
    """One row per channel of each file, without the channels of fewer than ``min_samples`` samples.

    The tags in a channel's comment become columns, ``NA`` where there are none.
    """
    names = [c.split(" ")[0] for c in CHANNELS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{"comment": None, "filename": name, **c} for name in batch["filename"] for c in enumerate_file(name)]
            if found:
                yield pd.DataFrame(found)[names]

    found = spread(files.select("filename"), "filename").mapInPandas(read, CHANNELS)
    found = found.where(F.col("sample_count") >= min_samples).withColumn("_tags", comment_tags(F.col("comment")))
    return found.select(*names[:-1], *[F.col(f"_tags.{key}").alias(key) for key in COMMENT_KEYS])


def number_channels(channels: DataFrame) -> DataFrame:
    """Running channel number per file, by group and index."""
    order = Window.partitionBy("filename").orderBy("group_idx", "channel_idx")
    return channels.withColumn("channel_id", F.row_number().over(order))


def split_channels(channels: DataFrame, max_samples: int) -> DataFrame:
    """Cut channels into pieces of at most ``max_samples``, so that one huge channel is read by many tasks."""
    pieces = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("sample_count") - 1, F.lit(max_samples)))
    rows = channels.withColumn("_piece", F.explode(pieces)).withColumn("first_sample", F.col("_piece") * max_samples)
    return rows.drop("_piece").withColumn("n_samples", F.least(F.lit(max_samples), F.col("sample_count") - F.col("first_sample")))


def assign_bins(tasks: DataFrame, max_samples: int, shard: Column, size: str = "n_samples") -> DataFrame:
    """Put tasks into bins of about ``max_samples``, neighbours of a file together.

    Within a shard the samples before a task, divided by the bin size, give its bin; a bin never holds more than
    ``max_samples`` plus its last task. Shards are packed independently, so no task sees the whole plan.
    """
    order = Window.partitionBy("_shard").orderBy("filename", "channel_id", "first_sample")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tasks.withColumn("_shard", shard)
    return rows.select(
        *tasks.columns,
        F.col("_shard").alias("shard"),
        F.call_function("div", before, F.lit(max_samples)).alias("bin"),
    )


def read_bins(tasks: DataFrame, decode: Decoder) -> DataFrame:
    """Read all pieces: container, file, channel, tags, ``time`` and ``value`` of every sample.

    The tasks bring the recording id, so that no join has to move samples. Tasks of a bin share a partition, sorted by
    file. Channels whose values are no numbers give no rows; invalid samples are NaN.
    """
    by = ["shard", "bin"]
    return read_tasks(spread(tasks, *by).sortWithinPartitions(*by, *ORDER), decode)


def attach_containers(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The recording id of each row's file; best given to the tasks, before there are samples."""
    return rows.join(ledger.select("filename", "container_id"), "filename")


def wide_to_samples(
    wide: DataFrame, ids: list[str], time_of_day: str = "Time", date: str = "date", ticks_per_second: int = 1_000_000
) -> DataFrame:
    """Rows of ``Time`` and one column per signal to long samples; rows with a missing time or signal are left out whole.

    The header ``Speed [km/h]`` gives name and unit.
    """
    signals = [c for c in wide.columns if c not in (*ids, time_of_day, date)]
    stamp = F.to_timestamp(F.concat_ws(" ", F.col(date), F.col(time_of_day)))
    rows = wide.dropna(subset=[time_of_day, date, *signals]).withColumn("time", ticks_of(stamp, ticks_per_second))
    rows = rows.select(*ids, "time", *[F.col(f"`{c}`").cast("double").alias(c) for c in signals])
    long = rows.unpivot([*ids, "time"], [f"`{c}`" for c in signals], "header", "value")
    return long.select(
        *ids,
        signal_name(F.col("header")).alias("channel_name"),
        signal_unit(F.col("header")).alias("unit"),
        "time",
        "value",
    )


def replicate(samples: DataFrame, times: int, grid: TimeGrid, key: str = "container_id") -> DataFrame:
    """Append ``times`` copies of each recording, each shifted by the last time of the one before it."""
    if times < 0:
        raise ValueError("times must not be negative")
    last = scan(samples, (key,), ("time",), grid, "time", _last=key_max(F.col("time")))
    copies = F.sequence(F.lit(0), F.lit(times))
    rows = last.withColumn("_copy", F.explode(copies))
    return rows.withColumn("time", F.col("time") + F.col("_copy") * F.col("_last")).drop("_copy", "_last")

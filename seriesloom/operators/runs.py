"""Run-length encoding of samples, and the way back to points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from seriesloom.operators.grid import SLICE, TimeGrid
from seriesloom.operators.scans import following, in_slices, known_rows, scan, stitch

CHANNEL_KEY = ("container_id", "channel_id")


def encode_runs(
    samples: DataFrame,
    grid: TimeGrid,
    keys: tuple[str, ...] = CHANNEL_KEY,
    tiebreak: str | None = None,
) -> DataFrame:
    """Collapse equal neighbouring values of (``time``, ``value``) into runs ``[tstart, tend)``.

    Rows without a key or a time are no samples. A run ends where the next one starts; the last run ends at its own last sample. NaN equals NaN, NULL equals nothing.
    Samples at the same time are ordered by ``tiebreak``, or by value. Where single instants hold very many copies of a
    sample (see ``TimeGrid.many_copies``), these are combined first, on the map side as well: a copy never changes a run,
    except that each NULL starts a run of its own, so those are kept.
    """
    order = tiebreak or "value"
    rows = known_rows(samples.select(*keys, "time", "value", *([tiebreak] if tiebreak else [])), keys, "time")
    runs = _in_slices(rows, keys, order, grid, tiebreak) if grid.sliced else _in_one_window(rows, keys, order)
    return runs.select(
        *keys, F.col("time").alias("tstart"), F.col("tend"), F.col("value").cast("double").alias("value")
    )


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _starts(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows that differ from the row before, with the time of the next such row and the last time of all rows."""
    w = Window.partitionBy(*keys).orderBy("time", order)
    marked = rows.select(
        "*",
        F.lag(F.struct("value")).over(w).alias("_before"),
        F.max("time").over(Window.partitionBy(*keys)).alias("_last"),
    )
    starts = marked.where(~_same(F.col("value"), F.col("_before.value")))
    return starts.withColumn("_next", F.lead("time").over(w))


def _in_one_window(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return _starts(rows, keys, order).withColumn("tend", F.coalesce("_next", "_last"))


def _in_slices(
    rows: DataFrame, keys: Sequence[str], order: str, grid: TimeGrid, tiebreak: str | None
) -> DataFrame:
    if grid.many_copies and not tiebreak:
        counted = rows.groupBy(*keys, "time", "value").agg(F.count(F.lit(1)).alias("_n"))
        kept = F.when(F.col("value").isNull(), F.col("_n")).otherwise(F.lit(1).cast("long"))
        rows = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), kept))).drop("_n", "_copy")
    rows = in_slices(rows, keys, grid, "time")
    local = _starts(rows, (*keys, SLICE), order)
    first = F.col("_before").isNull()
    at = F.struct("time", order)
    summary = {
        "_first_time": F.min("time"),
        "_first_value": F.min_by(F.struct("value"), at),
        "_last_value": F.max_by(F.struct("value"), at),
        "_inner": F.min(F.when(~first, F.col("time"))),
        "_end": F.max("_last"),
    }

    def carry(slices: DataFrame, over: WindowSpec) -> DataFrame:
        goes_on = _same(F.col("_first_value.value"), F.lag("_last_value").over(over)["value"])
        slices = slices.withColumn("_goes_on", goes_on)
        start = F.when(F.col("_goes_on"), F.col("_inner")).otherwise(F.col("_first_time"))
        slices = slices.withColumn("_start", start)
        after = over.rowsBetween(1, Window.unboundedFollowing)
        whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return slices.select(
            "*",
            F.first("_start", ignorenulls=True).over(after).alias("_next_start"),
            F.max("_end").over(whole).alias("_key_end"),
        ).drop("_start")

    stitched = stitch(local, rows.columns, keys, summary, carry)
    kept = stitched.where(~(first & F.col("_goes_on")))
    return kept.withColumn("tend", F.coalesce("_next", "_next_start", "_key_end"))


def polyline(runs: DataFrame) -> DataFrame:
    """Corner points of the step line: (tstart, value) and, when the run has a length, (tend, value)."""
    return runs.select(
        *[c for c in runs.columns if c not in ("tstart", "tend", "value")],
        F.explode(F.array_distinct(F.array("tstart", "tend"))).alias("t"),
        "value",
    )


def samples_as_runs(samples: DataFrame, grid: TimeGrid, keys: tuple[str, ...] = CHANNEL_KEY) -> DataFrame:
    """Zero-order hold without merging: every sample holds until the next one."""
    held = scan(samples, keys, ("time",), grid, "time", _next=following(F.col("time")))
    return held.select(
        *keys,
        F.col("time").alias("tstart"),
        F.coalesce("_next", "time").alias("tend"),
        F.col("value").cast("double").alias("value"),
    )

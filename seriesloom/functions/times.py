"""Ticks and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_of(ts: Column) -> Column:
    """Microseconds since the epoch. A timestamp without zone is read in the session time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def ticks_of(ts: Column, ticks_per_second: int) -> Column:
    """Ticks since the epoch, in whole numbers all the way."""
    if ticks_per_second >= 1_000_000:
        return micros_of(ts) * F.lit(ticks_per_second // 1_000_000)
    return F.call_function("div", micros_of(ts), F.lit(1_000_000 // ticks_per_second))


def timestamp_of(ticks: Column, ticks_per_second: int) -> Column:
    """The timestamp of a tick count, cut to microseconds."""
    if ticks_per_second >= 1_000_000:
        return F.timestamp_micros(F.call_function("div", ticks, F.lit(ticks_per_second // 1_000_000)))
    return F.timestamp_micros(ticks * F.lit(1_000_000 // ticks_per_second))


def parse_timestamp(text: Column) -> Column:
    """Accept ``2025-10-01T00:00``, ``2025-10-01 00:00`` and the same with seconds; NULL for anything else."""
    spaced = F.regexp_replace(text, "T", " ")
    full = F.when(F.length(spaced) == 16, F.concat(spaced, F.lit(":00"))).otherwise(spaced)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss"))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")

"""Putting several series of one recording on one time axis.

All operators here take *disjoint* runs (``tstart``, ``tend``) per source and recording. The starts of all runs are walked
in order: the state of a source is its last started run. An overlap of several runs begins at the latest of their starts,
so each is found at one start, with its bounds. This costs one shuffle for any number of sources and is linear in the
number of runs; no pairs are formed and thrown away. On a sliced grid no run is copied, however many slices it lasts: the
scan passes the last run of each source on from slice to slice, one row for each slice that holds a start.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.scans import following, key_max, last_known, running_max_before, scan

KEY = ("container_id",)


def _payload(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def overlaps(
    sources: Mapping[str, DataFrame], grid: TimeGrid, keys: Sequence[str] = KEY
) -> DataFrame:
    """Every maximal stretch where all sources have a run.

    Result: the keys, ``tstart``, ``tend`` of the stretch and one struct per source with the columns of its run.
    """
    names = list(sources)
    parts = []
    for number, name in enumerate(names):
        df = sources[name].where(F.col("tend") > F.col("tstart"))
        run = F.struct(*[F.col(c) for c in _payload(df, keys)])
        parts.append(
            df.select(
                *keys,
                F.col("tstart").alias("_t"),
                F.lit(number).alias("_source"),
                *[(run if other == name else _null_like(sources[other], keys)).alias(other) for other in names],
            )
        )
    events = reduce(DataFrame.unionByName, parts)
    states = {f"_run_{n}": last_known(F.col(n)) for n in names}
    state = scan(events, keys, ("_t", "_source"), grid, "_t", _next=following(F.col("_t")), **states)
    state = state.select(*keys, "_t", "_next", *[F.col(f"_run_{n}").alias(n) for n in names])
    end = F.least(*[F.col(f"{n}.tend") for n in names]) if len(names) > 1 else F.col(f"{names[0]}.tend")
    alive = F.lit(True)
    for n in names:
        alive = alive & F.col(n).isNotNull()
    last_of_instant = F.col("_next").isNull() | (F.col("_next") != F.col("_t"))
    return (
        state.where(alive & last_of_instant)
        .withColumn("tend", end)
        .where(F.col("tend") > F.col("_t"))
        .select(*keys, F.col("_t").alias("tstart"), "tend", *names)
    )


def _null_like(df: DataFrame, keys: Sequence[str]) -> Column:
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name in _payload(df, keys)]
    return F.lit(None).cast(T.StructType(fields))


def locate(
    points: DataFrame,
    runs: DataFrame,
    grid: TimeGrid,
    keys: Sequence[str] = KEY,
    closed: bool = True,
) -> DataFrame:
    """For each point (column ``t``) the run holding it, as struct ``run``; points outside every run are left out.

    The run is the last one started at or before the point, if it has not ended before it. ``closed`` lets a run hold
    its own end point when no other run starts there.
    """
    cols = _payload(runs, keys)
    extra = [c for c in points.columns if c not in (*keys, "t")]
    point_type = points.select(*extra).schema if extra else None
    rows = runs.select(
        *keys,
        F.col("tstart").alias("t"),
        F.lit(0).alias("_kind"),
        F.struct(*cols).alias("_start"),
        *([F.lit(None).cast(_nullable(point_type)).alias("_point")] if extra else []),
    ).unionByName(
        points.select(
            *keys,
            "t",
            F.lit(1).alias("_kind"),
            _null_like(runs, keys).alias("_start"),
            *([F.struct(*extra).alias("_point")] if extra else []),
        )
    )
    found = scan(rows, keys, ("t", "_kind"), grid, "t", _run=last_known(F.col("_start")))
    inside = F.col("t") <= F.col("_run.tend") if closed else F.col("t") < F.col("_run.tend")
    return found.where((F.col("_kind") == 1) & inside).select(
        *keys, "t", *[F.col(f"_point.{c}").alias(c) for c in extra], F.col("_run").alias("run")
    )


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def merge_islands(rows: DataFrame, grid: TimeGrid, keys: Sequence[str] = KEY) -> DataFrame:
    """Unions of overlapping and touching intervals: an island starts after everything before has ended."""
    reach = running_max_before(F.col("tend"))
    marked = scan(rows, keys, ("tstart", "tend"), grid, "tstart", _reach=reach, _end=key_max(F.col("tend")))
    marked = marked.select(*keys, "tstart", "_reach", "_end")
    starts = marked.where(F.col("_reach").isNull() | (F.col("tstart") > F.col("_reach")))
    starts = scan(starts, keys, ("tstart",), grid, "tstart", _next=following(F.col("_reach")))
    return starts.select(*keys, "tstart", F.coalesce("_next", "_end").alias("tend"))

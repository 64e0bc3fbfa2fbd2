"""Ordered scans that do not put a whole key into one task.

``scan`` adds columns computed along an order (previous row, running sum, last known value, ...). Without slices this is
one window per key. With slices each scan works in three steps: inside (key, slice), then over one summary row per slice,
then the two are put together by a join of the summaries on (key, slice), which the rows are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from seriesloom.operators.grid import SLICE, TimeGrid


@dataclass(frozen=True)
class Scan:
    """One scanned column.

    ``local`` works on the rows of one window; ``summary`` turns the rows of a slice into one value, given the order
    as a struct; ``carry`` passes summaries on between slices; ``merge`` combines the local value with the carried one.
    """

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[WindowSpec, Column], Column]
    merge: Callable[[Column, Column], Column]


def _upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def _whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _coalesce(local: Column, carried: Column) -> Column:
    return F.coalesce(local, carried)


def previous(value: Column) -> Scan:
    """The value of the row before; wrap nullable values in a struct to tell "null" from "no row"."""
    return Scan(
        lambda w: F.lag(value).over(w),
        lambda order: F.max_by(value, order),
        lambda w, s: F.lag(s).over(w),
        _coalesce,
    )


def following(value: Column) -> Scan:
    """The value of the row after."""
    return Scan(
        lambda w: F.lead(value).over(w),
        lambda order: F.min_by(value, order),
        lambda w, s: F.lead(s).over(w),
        _coalesce,
    )


def running_sum(value: Column) -> Scan:
    """Sum of the rows up to and including this one."""
    return Scan(
        lambda w: F.sum(value).over(_upto(w)),
        lambda order: F.sum(value),
        lambda w, s: F.sum(s).over(_before(w)),
        lambda local, carried: F.when(local.isNull(), carried)
        .when(carried.isNull(), local)
        .otherwise(local + carried),
    )


def running_count() -> Scan:
    """Row number, from 1."""
    one = F.lit(1).cast("long")
    return Scan(
        lambda w: F.row_number().over(w).cast("long"),
        lambda order: F.sum(one),
        lambda w, s: F.sum(s).over(_before(w)),
        lambda local, carried: local + F.coalesce(carried, F.lit(0).cast("long")),
    )


def running_max_before(value: Column) -> Scan:
    """Largest value of the rows before this one."""
    return Scan(
        lambda w: F.max(value).over(_before(w)),
        lambda order: F.max(value),
        lambda w, s: F.max(s).over(_before(w)),
        lambda local, carried: F.greatest(local, carried),
    )


def last_known(value: Column) -> Scan:
    """Last non-null value up to and including this row."""
    return Scan(
        lambda w: F.last(value, ignorenulls=True).over(_upto(w)),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda w, s: F.last(s, ignorenulls=True).over(_before(w)),
        _coalesce,
    )


def next_known(value: Column) -> Scan:
    """First non-null value of the rows after this one."""
    return Scan(
        lambda w: F.first(value, ignorenulls=True).over(_after(w)),
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda w, s: F.first(s, ignorenulls=True).over(_after(w)),
        _coalesce,
    )


def _whole_key(agg: Callable[[Column], Column], merge: Callable[[Column, Column], Column]):
    def make(value: Column) -> Scan:
        return Scan(
            lambda w: agg(value).over(_whole(w)),
            lambda order: agg(value),
            lambda w, s: (F.sum(s) if agg is F.count else agg(s)).over(_whole(w)),
            merge,
        )

    return make


#: Largest and smallest value and number of non-null values of the whole key, on every row.
key_max = _whole_key(F.max, lambda local, carried: carried)
key_min = _whole_key(F.min, lambda local, carried: carried)
key_count = _whole_key(F.count, lambda local, carried: carried)


def known_rows(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows with a key and a time. Others are no samples and go, whatever the grid."""
    for c in (*keys, time):
        df = df.where(F.col(c).isNotNull())
    return df


def in_slices(df: DataFrame, keys: Sequence[str], grid: TimeGrid, time: str) -> DataFrame:
    """Rows shuffled by (key, slice)."""
    return by_slices(grid.with_slice(df, time), keys)


def by_slices(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have their slice already, shuffled by (key, slice).

    The filter says what the join of the summaries would ask of one side only; said for both sides, the two branches of a
    scan stay alike below the shuffle, and Spark runs it once.
    """
    for c in (*keys, SLICE):
        rows = rows.where(F.col(c).isNotNull())
    return rows.repartition(*keys, SLICE)


def stitch(
    local: DataFrame,
    shuffled: Sequence[str],
    keys: Sequence[str],
    summary: Mapping[str, Column],
    carry: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Give the rows of each slice what the other slices of the key know.

    ``local`` holds the rows with what was computed inside their slice, ``shuffled`` names the columns that went through
    the shuffle. ``summary`` makes one row per slice; ``carry`` adds columns to these, with a window over the slices of a
    key in their order. The result is joined back: it is small, and both sides are partitioned by (key, slice) already.
    """
    by_slice = [*keys, SLICE]
    # The hash is never null. Asking for it makes both branches read the same columns of the shuffle.
    seen = F.max(F.xxhash64(*shuffled)).alias("_seen")
    slices = local.groupBy(*by_slice).agg(*[c.alias(n) for n, c in summary.items()], seen)
    slices = slices.where(F.col("_seen").isNotNull()).drop("_seen")
    carried = carry(slices, Window.partitionBy(*keys).orderBy(SLICE))
    return local.join(carried.drop(*summary), by_slice, "left")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    grid: TimeGrid,
    time: str,
    **scans: Scan,
) -> DataFrame:
    """Add one column per scan. ``order`` must start with a column that orders rows as ``time`` does."""
    df = known_rows(df, keys, time)
    if not grid.sliced:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[s.local(w).alias(name) for name, s in scans.items()])

    rows = in_slices(df, keys, grid, time)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    local = rows.select("*", *[s.local(w).alias(f"_l_{name}") for name, s in scans.items()])
    order_key = F.struct(*order)
    stitched = stitch(
        local,
        rows.columns,
        keys,
        {f"_s_{name}": s.summary(order_key) for name, s in scans.items()},
        lambda slices, over: slices.select(
            "*", *[s.carry(over, F.col(f"_s_{name}")).alias(f"_c_{name}") for name, s in scans.items()]
        ),
    )
    return stitched.select(
        *df.columns,
        *[s.merge(F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name) for name, s in scans.items()],
    )


def step_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    grid: TimeGrid,
    time: str,
    columns: Sequence[str],
    **steps: Callable[[Column, Column], Column],
) -> DataFrame:
    """Running sums of steps between neighbouring rows. A step gets the previous and the present row as structs of
    ``columns``; the first row of a key has a step of 0. One pass, where a scan for the neighbours and another for the
    sums would be two.
    """
    df = known_rows(df, keys, time)
    here = F.struct(*columns)

    def zero(row: Column, step: Callable[[Column, Column], Column]) -> Column:
        return step(row, row) * 0

    def with_sums(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_before", F.lag(here).over(w))
        added = [F.coalesce(step(F.col("_before"), here), zero(here, step)).alias(f"_d_{n}") for n, step in steps.items()]
        rows = rows.select("*", *added)
        return rows.select("*", *[F.sum(f"_d_{n}").over(_upto(w)).alias(n) for n in steps]).drop(
            "_before", *[f"_d_{n}" for n in steps]
        )

    if not grid.sliced:
        return with_sums(df, Window.partitionBy(*keys).orderBy(*order))

    rows = in_slices(df, keys, grid, time)
    local = with_sums(rows, Window.partitionBy(*keys, SLICE).orderBy(*order))
    order_key = F.struct(*order)

    def carry(slices: DataFrame, over: WindowSpec) -> DataFrame:
        # The step into a slice is known only here; it counts for all rows of the slice.
        enter = [
            F.coalesce(step(F.lag("_last").over(over), F.col("_first")), zero(F.col("_first"), step)).alias(f"_e_{n}")
            for n, step in steps.items()
        ]
        slices = slices.select("*", *enter)
        earlier = {n: F.sum(F.col(f"_e_{n}") + F.col(f"_t_{n}")).over(_before(over)) for n in steps}
        return slices.select(
            "*", *[(F.col(f"_e_{n}") + F.coalesce(earlier[n], F.col(f"_e_{n}") * 0)).alias(f"_c_{n}") for n in steps]
        )

    summary = {"_first": F.min_by(here, order_key), "_last": F.max_by(here, order_key)}
    summary.update({f"_t_{n}": F.max_by(n, order_key) for n in steps})
    stitched = stitch(local, rows.columns, keys, summary, carry)
    return stitched.select(*df.columns, *[(F.col(n) + F.col(f"_c_{n}")).alias(n) for n in steps])

"""Points for charts: windows, downsampling, normalising."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.scans import key_count, key_max, key_min, running_count, scan

CHANNEL = ("container_id", "channel_id")


def window_points(points: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Points from ``lo`` to ``hi``, both included; the filter reaches the file scan."""
    if lo is not None:
        points = points.where(F.col("t") >= lo)
    if hi is not None:
        points = points.where(F.col("t") <= hi)
    return points


def window_runs(runs: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Runs touching the window."""
    if hi is not None:
        runs = runs.where(F.col("tstart") <= hi)
    if lo is not None:
        runs = runs.where(F.col("tend") >= lo)
    return runs


def point_counts(points: DataFrame, lo: int, hi: int, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """All points and points of the window, per channel."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_points"),
        F.count_if(F.col("t").between(lo, hi)).alias("window_points"),
    )


def normalise(points: DataFrame, grid: TimeGrid, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """``v`` scaled to [0, 1] over the whole channel (a flat channel gives 0), ``v_raw`` beside it, ``t`` in seconds."""
    rows = scan(
        points, keys, ("t",), grid, "t", _lo=key_min(F.col("value")), _hi=key_max(F.col("value"))
    )
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return rows.select(
        *keys,
        grid.seconds(F.col("t")).alias("t"),
        F.round((F.col("value") - F.col("_lo")) / span, 6).alias("v"),
        F.round("value", 6).alias("v_raw"),
    )


def evenly_spaced(points: DataFrame, n_out: int, grid: TimeGrid, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """The points at ``n_out`` evenly spaced positions of each channel, ends included; shorter channels unchanged."""
    if n_out < 2:
        raise ValueError("at least the two end points")
    rows = scan(points, keys, ("t", "value"), grid, "t", _row=running_count(), _n=key_count(F.col("t")))
    i, last = F.col("_row") - 1, F.col("_n") - 1
    steps = n_out - 1
    near = F.bround(i * steps / last)

    def position(k):
        return F.bround(k * last / F.lit(float(steps)))

    chosen = F.lit(False)
    for shift in (-1, 0, 1):
        k = near + shift
        chosen = chosen | ((k >= 0) & (k <= steps) & (position(k) == i))
    return rows.where(F.when(F.col("_n") <= n_out, True).otherwise(chosen)).drop("_row", "_n")


def bucket_edges(n: int, n_out: int) -> np.ndarray:
    """First positions of the inner buckets of ``n`` points, and the position after the last of them."""
    k = np.arange(n_out - 1, dtype=object)
    return (1 + k * (n - 2) // (n_out - 2)).astype(np.int64)


def _areas(a: tuple[float, float], t: np.ndarray, v: np.ndarray, c: tuple[float, float]) -> np.ndarray:
    """Twice the areas of the triangles from point ``a`` over the points (t, v) to ``c``; -1 where there is none."""
    area = np.abs((a[0] - c[0]) * (v - a[1]) - (a[0] - t) * (c[1] - a[1]))
    return np.where(np.isfinite(area), area, -1.0)


def largest_triangles(t: np.ndarray, v: np.ndarray, n_out: int) -> np.ndarray:
    """Positions of a Largest-Triangle-Three-Buckets sample (Steinarsson 2013), first and last point kept.

    Of equal areas the first point counts; where no area is finite, the first point of the bucket.
    """
    n = len(t)
    if n <= n_out:
        return np.arange(n)
    edges = np.append(bucket_edges(n, n_out), n)
    picks = [0]
    with np.errstate(invalid="ignore"):
        for b in range(n_out - 2):
            lo, hi, after = edges[b : b + 3]
            at = picks[-1]
            area = _areas((t[at], v[at]), t[lo:hi], v[lo:hi], (t[hi:after].mean(), v[hi:after].mean()))
            picks.append(lo + int(np.argmax(area)))
    return np.array([*picks, n - 1])


#: Rounds of removing points below chords; what is left after them is kept, a corner or not.
ROUNDS = 32


def _outer(group: np.ndarray, t: np.ndarray, v: np.ndarray, side: int) -> np.ndarray:
    """Positions that hold all corners of the upper (side 1) or lower (side -1) hull of each group of points.

    The points are sorted by (group, t, v) and finite. Of equal times the outermost point stays; then, round by round and for
    all groups at once, every point goes that is not beyond the chord of its neighbours. Points are the proof that others
    are no corners, and stay so when they go themselves.
    """
    other = (group[1:] != group[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(np.r_[other, True] if side == 1 else np.r_[True, other])
    for _ in range(ROUNDS):
        if len(at) < 3:
            break
        a, b, c = at[:-2], at[1:-1], at[2:]
        turn = (t[b] - t[a]) * (v[c] - v[a]) - (t[c] - t[a]) * (v[b] - v[a])
        inner = (group[a] == group[c]) & (side * turn >= 0)
        if not inner.any():
            break
        at = at[np.r_[True, ~inner, True]]
    return at


def _reduce(keys: Sequence[str]):
    """Points of any number of buckets, in any order, to the possible corners of each bucket's hull.

    A bucket's first point always stays, and carries the totals of the points that it stands for.
    """

    def run(batches):
        for batch in batches:
            rows = batch.to_pandas()
            if rows.empty:
                continue
            code = rows.groupby([*keys, "_bucket"], sort=False, dropna=False).ngroup().to_numpy()
            order = np.lexsort((rows["_i"].to_numpy(), code))
            rows, code = rows.iloc[order], code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            t, v = rows["_dt"].to_numpy(), rows["_v"].to_numpy()
            known = np.flatnonzero(np.isfinite(v))
            corners = [known[_outer(code[known], t[known], v[known], side)] for side in (1, -1)]
            at = np.unique(np.concatenate([first, *corners]))
            kept = rows.iloc[at].copy()
            heads = np.searchsorted(at, first)
            with np.errstate(invalid="ignore"):
                for c in ("_count", "_sum_t", "_sum_v"):
                    totals = np.zeros(len(at), rows[c].dtype)
                    totals[heads] = np.add.reduceat(rows[c].to_numpy(), first)
                    kept[c] = totals
            yield pa.RecordBatch.from_pandas(kept, schema=batch.schema, preserve_index=False)

    return run


def downsample(points: DataFrame, n_out: int, grid: TimeGrid, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Largest-Triangle-Three-Buckets sample of ``n_out`` points per channel; channels of up to so many pass unchanged.

    Points are ordered by (t, value), numbered by a scan and put into buckets by number. The largest triangle over a
    bucket always stands on a corner of the bucket's convex hull, and a corner of the whole is a corner of any part: so
    the points are reduced batch by batch where the scan leaves them, and again by bucket where recordings are sliced.
    One short pass over the few corners of a channel picks the points. The answer is that of the plain method at every
    size, up to ties by rounding. Values that are NaN, NULL or infinite make no triangle.
    """
    if n_out < 3:
        raise ValueError("at least three points")
    numbered = scan(
        points, keys, ("t", "value"), grid, "t", _i=running_count(), _n=key_count(F.col("t")), _t0=key_min(F.col("t"))
    )
    i, n, inner = F.col("_i") - 1, F.col("_n"), n_out - 2
    bucket = F.when(i == 0, -1).when(i == n - 1, inner).otherwise(F.call_function("div", i * inner - 1, n - 2))
    since = (F.col("t") - F.col("_t0")).cast("double")
    value = F.col("value").cast("double")
    rows = numbered.select(
        *keys,
        F.when(n <= n_out, i).otherwise(bucket).cast("int").alias("_bucket"),
        i.alias("_i"),
        "_n",
        "t",
        since.alias("_dt"),
        value.alias("_v"),
        F.lit(1).cast("long").alias("_count"),
        since.alias("_sum_t"),
        value.alias("_sum_v"),
        F.coalesce(F.isnan("value"), F.lit(False)).alias("_nan"),  # pandas takes NaN and NULL for one
    )

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_bucket", "_i"], kind="stable")
        columns = [*keys, "t", "_v", "_nan"]
        if group["_n"].iat[0] <= n_out:
            return group[columns]
        b, t, v = group["_bucket"].to_numpy(), group["_dt"].to_numpy(), group["_v"].to_numpy()
        start = np.append(np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b))
        with np.errstate(invalid="ignore"):
            count, sum_t, sum_v = (np.add.reduceat(group[c].to_numpy(), start[:-1]) for c in ("_count", "_sum_t", "_sum_v"))
            chosen = [0]
            for k in range(1, len(start) - 2):
                at, lo, hi = chosen[-1], start[k], start[k + 1]
                mean = (sum_t[k + 1] / count[k + 1], sum_v[k + 1] / count[k + 1])
                chosen.append(lo + int(np.argmax(_areas((t[at], v[at]), t[lo:hi], v[lo:hi], mean))))
        return group.iloc[[*chosen, len(b) - 1]][columns]

    reduce = _reduce(keys)
    corners = rows.mapInArrow(reduce, rows.schema)
    if grid.sliced:
        corners = corners.repartition(*keys, "_bucket").mapInArrow(reduce, rows.schema)
    chosen = corners.groupBy(*keys).applyInPandas(pick, rows.select(*keys, "t", "_v", "_nan").schema)
    value = F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("_v")).alias("value")
    return chosen.select(*keys, "t", value)

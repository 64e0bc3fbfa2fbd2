from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators.grid import SLICE, SliceBounds, TimeGrid, grid_of_bounds, measure_grid
from seriesloom.operators.runs import encode_runs, polyline

SCHEMA = "container_id bigint, channel_id int, time bigint, value double"


def encoded(spark, rows, grid):
    df = encode_runs(spark.createDataFrame(rows, SCHEMA), grid)
    return sorted(tuple(r)[2:] for r in df.collect())


def test_last_run_ends_at_its_last_sample(spark, grid):
    rows = [(1, 1, t, v) for t, v in [(0, 1.0), (10, 1.0), (30, 2.0), (95, 2.0), (100, 3.0)]]
    assert encoded(spark, rows, grid) == [(0, 30, 1.0), (30, 100, 2.0), (100, 100, 3.0)]


def test_nan_runs_collapse_and_nulls_do_not(spark, grid):
    nan = float("nan")
    got = encoded(spark, [(1, 1, t, v) for t, v in [(0, nan), (10, nan), (20, None), (30, None), (40, 1.0)]], grid)
    assert [(a, b) for a, b, _ in got] == [(0, 20), (20, 30), (30, 40), (40, 40)]


def test_ties_are_ordered_by_value(spark, grid):
    got = encoded(spark, [(1, 1, 0, 2.0), (1, 1, 0, 1.0), (1, 1, 9, 2.0)], grid)
    assert got == [(0, 0, 1.0), (0, 9, 2.0)]


def test_many_copies_do_not_change_the_runs(spark):
    rng = random.Random(3)
    base = [(c, 1, t, float(rng.randint(0, 2))) for c in range(5) for t in range(0, 200, 3)]
    rows = base + [r for r in base for _ in range(rng.randint(0, 3))] + [(1, 1, 30, None), (1, 1, 30, None)]
    plain = encoded(spark, rows, TimeGrid(1000))
    assert encoded(spark, rows, TimeGrid(1000, 20, many_copies=True)) == plain
    assert encoded(spark, rows, TimeGrid(1000, 20)) == plain


def test_random_samples_against_python(spark, grid):
    rng = random.Random(11)
    rows, want = [], []
    for c in range(60):
        times = sorted(rng.sample(range(-100, 200), rng.randint(1, 40)))
        values = [float(rng.randint(0, 1)) for _ in times]
        rows += [(c, 1, t, v) for t, v in zip(times, values)]
        starts = [k for k in range(len(times)) if k == 0 or values[k] != values[k - 1]]
        for n, k in enumerate(starts):
            end = times[starts[n + 1]] if n + 1 < len(starts) else times[-1]
            want.append((times[k], end, values[k]))
    assert encoded(spark, rows, grid) == sorted(want)


def test_polyline_emits_both_ends_once(spark):
    runs = spark.createDataFrame([(1, 0, 5, 1.0), (1, 5, 5, 2.0)], "container_id bigint, tstart bigint, tend bigint, value double")
    assert sorted(tuple(r) for r in polyline(runs).collect()) == [(1, 0, 1.0), (1, 5, 1.0), (1, 5, 2.0)]


def test_small_recordings_need_no_slices(spark):
    df = spark.range(100).select(F.lit(1).alias("container_id"), F.col("id").alias("time"))
    assert measure_grid(df, 1000, target_rows=1000) == TimeGrid(1000)


def test_a_large_recording_and_a_burst_are_split(spark):
    even = spark.range(20_000).select(F.lit(1).alias("container_id"), F.col("id").alias("time"))
    burst = spark.range(10_000).select(F.lit(2).alias("container_id"), (F.col("id") % 500).alias("time"))
    both = even.unionByName(burst)
    grid = measure_grid(both, 1000, target_rows=1000)
    assert grid.sliced and not grid.many_copies
    assert max(slice_sizes(both, grid).values()) <= 2000


def slice_sizes(rows, grid):
    sliced = grid.with_slice(rows, "time").groupBy("container_id", SLICE).count().collect()
    return {(r["container_id"], r[SLICE]): r["count"] for r in sliced}


def test_recordings_years_apart_are_cut_by_their_own_rows(spark):
    """Ten dense minutes, five years away from everything else, and a short recording that needs no slices."""
    year = 365 * 86_400_000
    dense = spark.range(40_000).select(F.lit(1).alias("container_id"), (F.col("id") * 15).alias("time"))
    far = spark.range(3_000).select(F.lit(2).alias("container_id"), (F.col("id") * 1_000 + 5 * year).alias("time"))
    short = spark.range(900).select(F.lit(3).alias("container_id"), (F.col("id") * 60_000 - year).alias("time"))
    alone = measure_grid(dense, 1000, target_rows=1000)
    grid = measure_grid(dense.unionByName(far).unionByName(short), 1000, target_rows=1000)
    for g in (alone, grid):
        sizes = [n for (c, _), n in slice_sizes(dense, g).items() if c == 1]
        assert len(sizes) == 40 and 700 <= min(sizes) and max(sizes) <= 1300 and not g.many_copies
    assert sorted(slice_sizes(far, grid)) == [(2, 0), (2, 1), (2, 2)]
    assert list(slice_sizes(short, grid)) == [(3, 0)]


def test_slices_do_not_fall_and_match_a_plain_search(spark):
    from bisect import bisect_right

    rng = random.Random(8)
    rows = [(c, int(rng.gauss(c * 10_000, 300 ** (1 + c % 3)))) for c in range(4) for _ in range(2500)]
    samples = spark.createDataFrame(rows, "container_id bigint, time bigint")
    grid = measure_grid(samples, 1000, target_rows=100)
    starts = {r["container_id"]: r["starts"] for r in spark.read.parquet(grid.bounds.path).collect()}
    got = grid.with_slice(samples, "time").collect()
    assert len(got) == len(rows) and len(starts) == 4
    assert all(r[SLICE] == bisect_right(starts[r["container_id"]], r["time"]) for r in got)


def test_a_grid_is_read_back_without_measuring(spark, tmp_path):
    samples = spark.range(5000).select(F.lit(4).cast("long").alias("container_id"), F.col("id").alias("time"))
    grid = measure_grid(samples, 1000, target_rows=1000, folder=str(tmp_path / "slices"))
    assert grid_of_bounds(spark, str(tmp_path / "slices"), "container_id", 1000) == grid
    assert grid_of_bounds(spark, str(tmp_path / "slices"), "container_id", 7).ticks_per_second == 7


@pytest.mark.parametrize("slice_ticks", [1, 7, 40])
def test_equal_slices_change_no_run(spark, slice_ticks):
    rng = random.Random(slice_ticks)
    rows = [(c, 1, t, float(rng.randint(0, 1))) for c in range(8) for t in sorted(rng.sample(range(-50, 150), 40))]
    assert encoded(spark, rows, TimeGrid(1000, slice_ticks)) == encoded(spark, rows, TimeGrid(1000))


def test_copies_of_one_instant_are_noticed(spark):
    df = spark.range(10_000).select(
        F.lit(1).alias("container_id"), F.when(F.col("id") < 5000, F.lit(77)).otherwise(F.col("id")).alias("time")
    )
    grid = measure_grid(df, 1000, target_rows=1000)
    assert grid.sliced and grid.many_copies


def test_grid_arguments():
    with pytest.raises(ValueError):
        TimeGrid(0)
    with pytest.raises(ValueError):
        TimeGrid(10, 0)
    with pytest.raises(ValueError):
        TimeGrid(10, 5, bounds=SliceBounds("x", "container_id", 1, 1))
    assert TimeGrid(1_000_000).ticks(1.5) == 1_500_000


@pytest.mark.parametrize("kind", ["one width", "bounds"])
def test_sliced_scan_shuffles_the_rows_once(spark, bounds, kind):
    """Both branches of a sliced scan must read one shuffle of the rows."""
    grid = TimeGrid(1000, 100) if kind == "one width" else grid_of_bounds(spark, bounds, "container_id", 1000)
    df = spark.range(1000).select(
        F.lit(1).cast("long").alias("container_id"),
        F.lit(1).alias("channel_id"),
        F.col("id").alias("time"),
        (F.col("id") % 3).cast("double").alias("value"),
    )
    out = encode_runs(df, grid)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (0, 1000") == 1
    assert "ReusedExchange" in plan


def test_rows_without_key_or_time_are_no_samples(spark, grid):
    rows = [(1, 1, 0, 1.0), (1, 1, None, 1.0), (None, 1, 3, 5.0), (1, None, 4, 5.0), (1, 1, 20, 1.0), (1, 1, 40, None)]
    samples = spark.createDataFrame(rows, "container_id bigint, channel_id int, time bigint, value double")
    got = sorted(tuple(r) for r in encode_runs(samples, grid).select("container_id", "tstart", "tend", "value").collect())
    assert got == [(1, 0, 40, 1.0), (1, 40, 40, None)]

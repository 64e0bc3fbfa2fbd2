from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.binning import bin_index, bin_label
from seriesloom.operators import histograms as H
from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.series import Intervals, PointsInTime, SampleSeries
from seriesloom.operators.statistics import LABELS, event_statistics, typed_statistics, weighted_median

EDGES = [0, 1, 2.5, 4, 10]
RUNS = "container_id bigint, tstart bigint, tend bigint, value double"


def test_bin_index_is_numpys(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.uniform(-2, 12, 500), np.array(EDGES, float), [np.nan]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = df.select("v", bin_index(F.col("v"), EDGES).alias("b")).where(F.col("b").isNotNull())
    counts = {r["b"]: r["count"] for r in found.groupBy("b").count().collect()}
    want, _ = np.histogram(values[~np.isnan(values)], EDGES)
    assert [counts.get(i, 0) for i in range(len(EDGES) - 1)] == want.tolist()
    assert bin_label(EDGES, 1) == "1 - 2.5"


@pytest.mark.parametrize("edges", [[1], [1, 1], [2, 1]])
def test_bad_edges(edges):
    with pytest.raises(ValueError):
        bin_index(None, edges)


@pytest.fixture
def two(spark, grid):
    a = [(1, 0, 10, 0.5), (1, 10, 30, 2.5), (1, 30, 40, 99.0), (2, 0, 5, 50.0), (1, 40, 40, 1.0)]
    b = [(1, 5, 25, 1.0), (1, 25, 50, 5.0)]
    return [SampleSeries(spark.createDataFrame(rows, RUNS), grid) for rows in (a, b)]


def values(fact):
    out = {}
    for r in fact.orderBy("container_id", "bin_id").collect():
        out.setdefault(r["container_id"], []).append(r["hist_value"])
    return out


def test_duration_histogram_fills_zeros_and_drops_outliers(two):
    assert values(H.duration_histogram(two[0], EDGES)) == {1: [10.0, 0.0, 20.0, 0.0], 2: [0.0] * 4}


def test_duration_histogram_with_event_and_cap(two, grid):
    event = two[1] > 2
    assert values(H.duration_histogram(two[0], EDGES, event)) == {1: [0.0, 0.0, 5.0, 0.0]}
    assert values(H.duration_histogram(two[0], EDGES, max_duration=8)) == {1: [8.0, 0.0, 8.0, 0.0], 2: [0.0] * 4}


def test_distance_needs_a_weight(two):
    with pytest.raises(TypeError):
        H.distance_histogram(two[0], None, EDGES)


def test_distance_histogram_counts_each_increment_once(spark, grid, two):
    odo = [(1, 0, 4, 100.0), (1, 4, 12, 103.0), (1, 12, 39, 110.0), (1, 39, 41, 115.0)]
    weight = SampleSeries(spark.createDataFrame(odo, RUNS), grid)
    # 3 km at t=4 (value 0.5), 7 km at t=12 (value 2.5), 5 km at t=39 (value 99: outside the bins)
    assert values(H.distance_histogram(two[0], weight, EDGES)) == {1: [3.0, 0.0, 7.0, 0.0]}


def test_duration_count_and_event_count(spark, grid, two):
    iv = Intervals(spark.createDataFrame([(1, 0, 3), (1, 5, 6), (1, 10, 20)], "container_id bigint, tstart bigint, tend bigint"), grid)
    assert values(H.duration_count_histogram(iv, EDGES, 2.0)) == {1: [0.0, 2.0, 2.0, 2.0]}
    points = PointsInTime(spark.createDataFrame([(1, 3), (1, 15), (1, 16)], "container_id bigint, t bigint"), grid)
    assert values(H.event_count_histogram(two[0], points, EDGES)) == {1: [1.0, 0.0, 2.0, 0.0]}


def test_joint_histogram(two):
    rows = H.joint_histogram(two, [EDGES, [0, 2, 10]]).where(F.col("hist_value") > 0)
    got = {(r["x_bin_id"], r["y_bin_id"]): r["hist_value"] for r in rows.collect()}
    assert got == {(0, 0): 5.0, (2, 0): 15.0, (2, 1): 5.0}


def test_wrong_types(two):
    with pytest.raises(TypeError):
        H.duration_histogram(two[0] > 1, EDGES)
    with pytest.raises(TypeError):
        H.duration_histogram(two[0], EDGES, two[0].rising_edges())
    with pytest.raises(ValueError):
        H.joint_histogram(two[:1], [EDGES])


def test_statistics_per_event(spark, grid):
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(60):
        length = rng.randint(1, 9)
        rows.append((1, t, t + length, float(rng.randint(0, 9))))
        t += length
    s = SampleSeries(spark.createDataFrame(rows, RUNS), grid)
    event = Intervals(spark.createDataFrame([(1, 10, 90), (1, 150, 151)], "container_id bigint, tstart bigint, tend bigint"), grid)
    got = {}
    for r in event_statistics({"x": s}, event, LABELS).collect():
        got.setdefault(r["event_instance_id"], {})[r["aggregation_label"]] = r["statistic_value"]
    want = []
    for lo, hi in ((10, 90), (150, 151)):
        parts = [(v, min(e, hi) - max(b, lo)) for _, b, e, v in rows if max(b, lo) < min(e, hi)]
        w = sum(x for _, x in parts)
        mean = sum(v * x for v, x in parts) / w
        total, median = 0, None
        for v, x in sorted(parts):
            total += x
            if median is None and total * 2 >= w:
                median = v
        std = math.sqrt(sum(x * (v - mean) ** 2 for v, x in parts) / w)
        vs = [v for v, _ in parts]
        want.append({"min": min(vs), "max": max(vs), "mean": mean, "median": median, "std": std, "count": len(vs)})
    found = sorted(got.values(), key=lambda d: -d["count"])
    for f, w in zip(found, want):
        assert f.keys() == w.keys()
        assert all(math.isclose(f[k], w[k], abs_tol=1e-6) for k in w)


def test_statistics_of_zero_length_recording(spark):
    s = SampleSeries(spark.createDataFrame([(1, 5, 5, 4.0), (1, 6, 6, 2.0)], RUNS), TimeGrid(1000))
    rows = {r["aggregation_label"]: r["statistic_value"] for r in event_statistics({"x": s}, None, LABELS).collect()}
    assert rows == {"min": 2.0, "max": 4.0, "mean": 3.0, "median": 2.0, "std": 1.0, "count": 2.0}


NUMBERS = "container_id bigint, tstart bigint, tend bigint, value double"


def test_std_of_a_large_offset(spark, grid):
    rows = [(1, 3 * i, 3 * i + 1 + i % 3, 1e9 + i % 3) for i in range(300)]
    s = SampleSeries(spark.createDataFrame(rows, NUMBERS), grid)
    values, weights = [r[3] for r in rows], [r[2] - r[1] for r in rows]
    mean = sum(v * w for v, w in zip(values, weights)) / sum(weights)
    want = math.sqrt(sum(w * (v - mean) ** 2 for v, w in zip(values, weights)) / sum(weights))
    got = event_statistics({"x": s}, None, ["std"]).first()["statistic_value"]
    assert math.isclose(got, want, rel_tol=1e-9)


def test_values_that_are_no_numbers_count_only(spark, grid):
    nan = float("nan")
    rows = [(1, i, i + 1, float(i + 1)) for i in range(3)] + [(1, 10, 110, nan), (2, 10, 110, None), (3, 0, 9, nan), (3, 9, 10, None)]
    rows += [(2, i, i + 1, float(i + 1)) for i in range(3)] + [(None, 0, 1, 1.0)]
    s = SampleSeries(spark.createDataFrame(rows, NUMBERS), grid)
    got = {}
    for r in event_statistics({"x": s}, None, LABELS).collect():
        got.setdefault(r["container_id"], {})[r["aggregation_label"]] = r["statistic_value"]
    want = {"min": 1.0, "max": 3.0, "mean": 2.0, "median": 2.0, "std": math.sqrt(2 / 3), "count": 4.0}
    for key in (1, 2):
        assert all(math.isclose(got[key][k], v) for k, v in want.items())
    assert got[3] == dict.fromkeys(want) | {"count": 2.0}
    assert set(got) == {1, 2, 3}


def test_statistics_by_type(spark, grid):
    iv = Intervals(spark.createDataFrame([(1, 0, 3), (1, 5, 6)], "container_id bigint, tstart bigint, tend bigint"), grid)
    rows = {r["aggregation_label"]: r["statistic_value"] for r in typed_statistics(iv, ["min", "max", "mean"]).collect()}
    assert rows == {"min": 1.0, "max": 3.0, "mean": 2.0}
    counts = typed_statistics(iv.start_points(), ["min", "max"]).collect()
    assert [(r["aggregation_label"], r["statistic_value"]) for r in counts] == [("count", 2.0)]


def test_unknown_label(two):
    with pytest.raises(ValueError):
        event_statistics({"x": two[0]}, None, ["mode"])


@pytest.mark.parametrize("pieces", [2, 16])
def test_median_in_pieces_is_exact(spark, pieces):
    rng = random.Random(9)
    rows, want = [], {}
    for key in range(30):
        data = [(rng.choice([1e9, 0.1, 0.2, rng.gauss(0, 5)]), rng.choice([0, 1, 5])) for _ in range(rng.randint(1, 80))]
        rows += [(key, v, w) for v, w in data]
        total = sum(w for _, w in data)
        weighted = [(v, w if total else 1) for v, w in sorted(data)]
        half, run = sum(w for _, w in weighted) / 2, 0
        for v, w in weighted:
            run += w
            if run >= half:
                want[key] = v
                break
    df = spark.createDataFrame(rows, "k int, value double, weight bigint")
    assert {r["k"]: r["median"] for r in weighted_median(df, ["k"], pieces).collect()} == want

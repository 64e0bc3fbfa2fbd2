from __future__ import annotations

import math

import pytest

from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.series import Intervals, PitSeries, PointsInTime, SampleSeries

GRID = TimeGrid(1000)


def series(spark, rows, grid=GRID):
    return SampleSeries(spark.createDataFrame(rows, "container_id bigint, tstart bigint, tend bigint, value double"), grid)


@pytest.fixture
def sample(spark):
    return series(spark, [(1, 0, 10, 1.0), (1, 10, 20, 3.0)])


def test_eval_types(sample):
    above = sample > 2
    rise = sample.rising_edges()
    assert [x.eval_type() for x in (sample, above, rise, sample.where(rise), sample.where(above))] == [
        "SampleSeries",
        "Intervals",
        "PointsInTime",
        "PitSeries",
        "SampleSeries",
    ]


def test_methods_exist_only_on_their_type(sample):
    with pytest.raises(AttributeError):
        sample.flipflop(sample.rising_edges())
    with pytest.raises(AttributeError):
        (sample > 1).max_within_intervals(sample > 2)


def test_wrong_operands_are_refused(sample):
    with pytest.raises(TypeError):
        sample.where(sample)
    with pytest.raises(TypeError):
        (sample > 1) & sample.rising_edges()
    with pytest.raises(TypeError):
        sample.rising_edges().flipflop(sample > 1)
    with pytest.raises(TypeError):
        sample + "x"


def test_grids_must_agree(spark, sample):
    other = series(spark, [(1, 0, 10, 1.0)], TimeGrid(1000, 50))
    with pytest.raises(ValueError):
        sample.aligned({"b": other})


def test_nan_and_null_meet_no_condition(spark):
    s = series(spark, [(1, 0, 10, float("nan")), (1, 10, 20, None), (1, 20, 30, 5.0)])
    for found in (s > 1, s != 0, s >= 5):
        assert [tuple(r) for r in found.frame.collect()] == [(1, 20, 30)]
    assert (s < 1).frame.count() == 0


def test_division_by_zero_is_null(spark, sample):
    zero = sample * 0
    assert [r["value"] for r in (sample / zero).frame.collect()] == [None, None]


def test_scalars_of_nothing_are_nan(spark):
    s = series(spark, [(1, 0, 10, float("nan")), (2, 5, 5, 4.0)])
    rows = {r["container_id"]: r for r in s.scalars().collect()}
    assert math.isnan(rows[1]["max"]) and math.isnan(rows[1]["mean"])
    assert rows[2]["max"] == 4.0 and math.isnan(rows[2]["mean"])


def test_empty_constructors(spark):
    for cls in (SampleSeries, Intervals, PointsInTime, PitSeries):
        empty = cls.empty(spark)
        assert empty.frame.count() == 0 and tuple(empty.frame.columns) == cls.columns


def test_metadata(sample):
    row = sample.metadata().first()
    assert (row["sample_count"], row["duration_ms"], row["start_time"], row["end_time"], row["nan_ratio"]) == (
        2,
        20.0,
        0,
        20,
        0.0,
    )
    assert row["sample_rate"] == 100.0

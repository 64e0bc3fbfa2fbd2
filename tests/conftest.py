from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from seriesloom.operators.grid import TimeGrid, grid_of_bounds  # noqa: E402
from tools.check_oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(partitions=4)
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def bounds(spark, tmp_path_factory):
    """Slices of 3 to 11 ticks, narrower than runs, for two of three recordings; the others are not sliced."""
    rows = [
        (c, [t + c % 5 for t in range(-150, 3000, 7)] if c % 2 else [*range(-140, 40, 3), *range(40, 400, 11)], False)
        for c in range(200)
        if c % 3 != 2
    ]
    path = str(tmp_path_factory.mktemp("grid") / "slices")
    spark.createDataFrame(rows, "container_id bigint, starts array<bigint>, copies boolean").write.parquet(path)
    return path


@pytest.fixture(params=["plain", "bounds"])
def grid(request, spark, bounds):
    """Every series test runs in one window and with slices of large recordings."""
    return TimeGrid(1000) if request.param == "plain" else grid_of_bounds(spark, bounds, "container_id", 1000)

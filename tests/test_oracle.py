"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tools.check_oracle import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    problem, rows = compare(spark, con, queries()[name], oracle_sql().get(name), SMOKE_DIR)
    assert problem is None
    assert rows > 0 or name in oracle_sql()


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())

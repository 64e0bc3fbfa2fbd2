"""Queries by name, each with the SQL that must give the same rows (or None where SQL cannot say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.model import Data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Data.of(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register

"""Small helpers: intermediate tables in the shared folder, and expressions that evaluate an argument once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.scratch import scratch_folder


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``frame`` written as a table in the shared folder and read back, which cuts the lineage.

    A lost executor costs at most the running stage; what is written survives.
    """
    folder = scratch_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(stem: str) -> str:
    """A column name that no input column has."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

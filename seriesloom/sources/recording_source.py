"""Recordings as a Spark data source: one input partition for each file of a written task table.

A task is a piece of one channel. The driver sees the names of the task table's files and nothing of its rows. A partition
reads its tasks, opens each recording once for the pieces of it that follow one another, and gives one row per block of
samples: what is constant for the piece once, times and values as arrays. Small blocks are sent together. Spark takes the
blocks apart, so names and tags are not sent for every sample, and columns that nobody asks for are never copied.

A condition on the recording, file or channel reaches the tasks where ``spark.sql.python.filterPushdown.enabled`` is set:
pieces that it rules out are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from seriesloom.functions.tags import COMMENT_KEYS
from seriesloom.sources.scratch import scratch_folder

#: A decoder reads one piece of one channel: (filename, group_idx, channel_idx, first_sample, n_samples) -> frame with
#: ``time``, ``value`` and, where samples may be invalid, ``invalid``. Pieces of one file come one after another, so a
#: decoder may keep its last file open.
Decoder = Callable[[str, int, int, int, int], pd.DataFrame]

#: What is constant for a piece, by type.
CONSTANT = {
    "container_id": pa.int64(),
    "filename": pa.string(),
    "channel_id": pa.int32(),
    "group_idx": pa.int32(),
    "channel_idx": pa.int32(),
    "channel_name": pa.string(),
    "unit": pa.string(),
    **{key: pa.string() for key in COMMENT_KEYS},
}
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}
_BLOCKS = ", ".join(f"{c} {_SQL[t]}" for c, t in CONSTANT.items()) + ", times array<bigint>, values array<double>"
#: Samples of a block; a batch of blocks holds less than twice as many.
BLOCK = 1 << 14
ORDER = ("filename", "group_idx", "channel_idx", "first_sample")


class TaskFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _tasks_of(path: str) -> pd.DataFrame:
    from pyarrow import fs
    from pyarrow import parquet as pq

    store, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return pq.read_table(name, filesystem=store, partitioning=None).to_pandas().sort_values(list(ORDER), kind="stable")


def numbers(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Times and values of a decoded piece; None if its values are no numbers. Invalid samples are NaN."""
    value = part["value"].to_numpy()
    if not np.issubdtype(value.dtype, np.number):
        return None
    value = value.astype(np.float64)  # a copy
    if "invalid" in part:
        value[part["invalid"].to_numpy(bool)] = np.nan
    return part["time"].to_numpy().astype(np.int64), value


def _blocks(held: list[tuple]) -> pa.RecordBatch:
    """Blocks (task, times, values) as rows."""
    constant = [pa.array([getattr(task, c) for task, _, _ in held], t) for c, t in CONSTANT.items()]
    edges = pa.array(np.cumsum([0, *(len(time) for _, time, _ in held)], dtype=np.int32))
    arrays = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([row[i] for row in held]))) for i in (1, 2)]
    return pa.RecordBatch.from_arrays([*constant, *arrays], names=[*CONSTANT, "times", "values"])


class RecordingReader(DataSourceReader):
    def __init__(self, decode: Decoder, files: list[str]) -> None:
        self.decode = decode
        self.files = files
        self.wanted: list[tuple[str, tuple]] = []

    def partitions(self) -> list[TaskFile]:
        return [TaskFile(f) for f in self.files]

    def read(self, partition: TaskFile) -> Iterator[pa.RecordBatch]:
        tasks = _tasks_of(partition.path)
        for column, values in self.wanted:
            tasks = tasks[tasks[column].isin(values)]
        held: list[tuple] = []
        samples = 0
        for task in tasks.itertuples(index=False):
            part = self.decode(task.filename, task.group_idx, task.channel_idx, task.first_sample, task.n_samples)
            found = numbers(part) if len(part) else None
            if found is None:
                continue
            time, value = found
            for at in range(0, len(time), BLOCK):
                held.append((task, time[at : at + BLOCK], value[at : at + BLOCK]))
                samples += len(held[-1][1])
                if samples >= BLOCK:
                    yield _blocks(held)
                    held, samples = [], 0
        if held:
            yield _blocks(held)


class FilteringReader(RecordingReader):
    """Takes conditions over; Spark lets a reader do so only where the setting is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in CONSTANT:
                self.wanted.append((f.attribute[0], tuple(values)))
            else:
                yield f


def register(spark: SparkSession, decode: Decoder, name: str = "recordings") -> None:
    """Make ``decode`` the reader behind ``spark.read.format(name)``, whose option ``files`` lists task files as JSON."""

    kind = FilteringReader if spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true" else RecordingReader

    class Recordings(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _BLOCKS

        def reader(self, schema) -> RecordingReader:
            return kind(decode, json.loads(self.options["files"]))

    spark.dataSource.register(Recordings)


def read_tasks(tasks: DataFrame, decode: Decoder) -> DataFrame:
    """The samples of all pieces: the constant columns, ``time`` and ``value``. ``tasks`` is written as it is dealt out."""
    spark = tasks.sparkSession
    folder = scratch_folder(spark, "tasks")
    known = set(tasks.columns)
    constant = [F.col(c) if c in known else F.lit("NA").alias(c) for c in CONSTANT]
    tasks.select(*constant, "first_sample", "n_samples").write.parquet(folder)
    files = sorted(spark.read.parquet(folder).inputFiles())
    register(spark, decode)
    blocks = spark.read.format("recordings").option("files", json.dumps(files)).load()
    samples = F.inline(F.arrays_zip(F.col("times").alias("time"), F.col("values").alias("value")))
    return blocks.select(*CONSTANT, samples)

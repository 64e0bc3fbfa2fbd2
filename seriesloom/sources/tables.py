"""Tables on plain parquet: upserts, versions, layout, clean-up."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """The target after a merge: matched rows get the ``update`` columns of the source, unmatched source rows are added.

    Without ``update`` whole rows are replaced. The keys must be unique in the source, as for any merge.
    """
    keys = list(keys)
    columns = target.columns
    if update is None:
        kept = target.join(source.select(*keys), keys, "left_anti")
        return kept.unionByName(source.select(*columns))
    fresh = source.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in update])
    changed = target.join(fresh, keys, "left").select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
            for c in columns
        ]
    )
    added = source.join(target.select(*keys), keys, "left_anti").select(*columns)
    return changed.unionByName(added)


def update_if_changed(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Take over the columns of the source row with the same key if at least one of them differs; add nothing."""
    fresh = source.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | F.coalesce(F.col(c) != F.col(f"_new_{c}"), F.lit(False))
    rows = target.join(fresh, key, "left").withColumn("_differs", differs)
    return rows.select(
        *[
            F.when(F.col("_differs"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def without_containers(df: DataFrame, containers: DataFrame) -> DataFrame:
    """Roll-back of one table: everything but the rows of the given recordings."""
    return df.join(containers.select("container_id"), "container_id", "left_anti")


def roll_back(tables: Mapping[str, DataFrame], ledger: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """All tables without the recordings of a failed run."""
    mine = ledger.where(F.col("run_id") == run_id)
    return {name: without_containers(df, mine) for name, df in tables.items()}


def union_tables(tables: Sequence[DataFrame], vehicles: Sequence[str] | None = None) -> DataFrame:
    """Several channel tables as one. With a vehicle per table, a later filter on it prunes whole tables."""
    if not tables:
        raise ValueError("at least one table")
    if vehicles is not None:
        if len(vehicles) != len(tables):
            raise ValueError("one vehicle per table")
        tables = [t.withColumn("vehicle_key", F.lit(v)) for t, v in zip(tables, vehicles)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def data_locations(mapping: DataFrame, vehicles: Sequence[str]) -> DataFrame:
    """The data tables of some vehicles, from the mapping table."""
    return mapping.where(F.col("vehicle_key").isin(list(vehicles))).select("vehicle_key", "location").distinct()


class VersionedTable:
    """A parquet table replaced as a whole: each write is a new folder, readers take the newest complete one.

    A folder is complete once Spark's commit has put its success marker there, so a job that dies while writing leaves
    the old version in force. Readers of an old version are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            marker = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("version=") and fs.exists(marker):
                found.append(int(name.removeprefix("version=")))
        return sorted(found)

    def exists(self) -> bool:
        return bool(self._versions())

    def create(self, schema: T.StructType) -> bool:
        """Make an empty table unless there is one."""
        if self.exists():
            return False
        self.write(self.spark.createDataFrame([], schema))
        return True

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/version={versions[-1]}")

    def write(self, df: DataFrame) -> None:
        number = (self._versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/version={number}")

    def upsert(self, source: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> None:
        self.write(upsert(self.read(), source, keys, update))

    def compact(self, keys: Sequence[str], rows_per_file: int = 5_000_000) -> None:
        """Rewrite in few, sorted files of about equal size."""
        df = self.read()
        files = max(1, -(-df.count() // rows_per_file))
        self.write(clustered(df, keys, files))


class BucketedTable:
    """A parquet table dealt into buckets by ``key`` and sorted in them: what is grouped, ordered or joined by the key over
    it needs no shuffle. For keys of which none holds much more than a bucket's share; very large recordings are better
    ``clustered``.

    The files lie in ``path``; ``read`` enters the table into the session's catalog where it is not known yet.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, sort: Sequence[str], buckets: int) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.key, self.sort, self.buckets = key, list(sort), buckets
        self.name = f"bucketed_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"

    def deal(self, df: DataFrame) -> DataFrame:
        """Rows in one task per bucket, as the table has them."""
        return df.repartition(self.buckets, self.key)

    def write(self, df: DataFrame, dealt: bool = False) -> None:
        """Replace the table. ``dealt`` says that the rows lie as ``deal`` puts them; then there is one file per bucket."""
        rows = df if dealt else self.deal(df)
        writer = rows.write.mode("overwrite").format("parquet").option("path", self.path)
        writer.bucketBy(self.buckets, self.key).sortBy(self.key, *self.sort).saveAsTable(self.name)

    def read(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(self.path).schema.fields)
            order = ", ".join(f"`{c}`" for c in (self.key, *self.sort))
            self.spark.sql(
                f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY ({order}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        return self.spark.table(self.name)


def clustered(df: DataFrame, keys: Sequence[str], files: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by the keys, so that file statistics let scans skip by recording and channel.

    Put the time last among the keys: then a large channel is spread over several files too.
    """
    spread = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A local copy of a table that changes often or is slow to reach."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def report_tables(spark: SparkSession, prefix: str) -> list[str]:
    """Names, without prefix, of the session's tables and views of a report."""
    head = f"{prefix}_"
    return sorted(t.name.removeprefix(head) for t in spark.catalog.listTables() if t.name.startswith(head))


def drop_report_tables(spark: SparkSession, prefix: str) -> list[str]:
    names = report_tables(spark, prefix)
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    for name in names:
        full = f"{prefix}_{name}"
        if full in temporary:
            spark.catalog.dropTempView(full)
        else:
            spark.sql(f"DROP TABLE IF EXISTS `{full}`")
    return names


def check_source(df: DataFrame, time: str, value: str) -> DataFrame:
    """First row of a candidate series source; a wrong expression fails here, while planning."""
    return df.select(F.expr(time).alias("tstart"), F.expr(value).alias("value")).limit(1)


def describe(df: DataFrame) -> DataFrame:
    """Columns and types."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string")

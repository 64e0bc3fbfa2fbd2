"""Time slices: how one long recording is spread over many tasks.

Series work is ordered work: the previous sample, the state at a time, a running total. Partitioning a window by
recording alone puts a whole recording into one task, however long it is. A ``TimeGrid`` cuts the time of large
recordings into slices of about equally many rows; the ordered operators then partition by (recording, slice) and pass only
a few values per slice on to the next one. Every series of a recording has the same slices.

Which recordings are large, and where their slices start, is a small table (``SliceBounds``): one row per large recording,
whatever else the archive holds and however far apart its recordings lie. Recordings that are not in it have one slice.
Without large recordings there is no table, and the plans are plain windows by recording.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.scratch import scratch_folder

SLICE = "_slice"
#: The columns of a table of bounds beside its key.
STARTS, COPIES = "starts", "copies"
#: A table of bounds with at most so many starts (8 bytes each) is brought to all tasks; a larger one is joined by key.
BROADCAST_STARTS = 4_000_000
#: A recording has at most so many slices.
MOST_CUTS = 8192


@dataclass(frozen=True)
class SliceBounds:
    """``path``: a written table of ``key``, ``starts`` (the first times of all slices but the first, ascending) and
    ``copies``. ``most``: the most starts of one recording, ``total``: those of all.
    """

    path: str
    key: str
    most: int
    total: int

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path).select(F.col(self.key), F.col(STARTS).alias("_starts"))
        return F.broadcast(rows) if self.total <= BROADCAST_STARTS else rows

    def slice_in(self, starts: Column, t: Column) -> Column:
        """How many of ``starts`` are not after ``t``, by halving; 0 where there are none."""
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(self.most.bit_length()))])
        return F.aggregate(
            steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step - 1) <= t, at + step).otherwise(at)
        ).cast("long")


@dataclass(frozen=True)
class TimeGrid:
    """Ticks per second of the time columns, and the slices.

    ``bounds`` names the slices of large recordings. ``slice_ticks`` cuts every recording into slices of one width
    instead, for callers who know their data. Without both nothing is sliced. ``many_copies`` says that single instants
    hold too many rows for one task, which no slicing can split; encoding then combines copies of a sample before it
    shuffles by slice.
    """

    ticks_per_second: int = 1_000_000_000
    slice_ticks: int | None = None
    many_copies: bool = False
    bounds: SliceBounds | None = None

    def __post_init__(self) -> None:
        if self.ticks_per_second <= 0:
            raise ValueError("ticks_per_second must be positive")
        if self.slice_ticks is not None and self.slice_ticks <= 0:
            raise ValueError("slice_ticks must be positive")
        if self.slice_ticks is not None and self.bounds is not None:
            raise ValueError("slices have one width or bounds, not both")

    @property
    def sliced(self) -> bool:
        return self.slice_ticks is not None or self.bounds is not None

    def with_slices(self, slice_ticks: int | None) -> TimeGrid:
        return replace(self, slice_ticks=slice_ticks, bounds=None)

    def ticks(self, seconds: float) -> int:
        """Whole ticks in a number of seconds."""
        return round(seconds * self.ticks_per_second)

    def seconds(self, ticks: Column) -> Column:
        return ticks / F.lit(float(self.ticks_per_second))

    def with_slice(self, rows: DataFrame, time: str) -> DataFrame:
        """``rows`` with the slice of their time. The slice never falls as the time of a recording grows."""
        if self.bounds is not None:
            found = rows.join(self.bounds.table(rows.sparkSession), self.bounds.key, "left")
            return found.select(*rows.columns, self.bounds.slice_in(F.col("_starts"), F.col(time)).alias(SLICE))
        if self.slice_ticks is not None:  # whole-number division: no tick is lost
            return rows.withColumn(SLICE, F.call_function("div", F.col(time), F.lit(self.slice_ticks)))
        return rows.withColumn(SLICE, F.lit(0).cast("long"))

    def parts(self, rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """``rows`` of recordings that are not sliced, and of those that are; None for a part that cannot have rows."""
        if self.bounds is None:
            return (None, rows) if self.sliced else (rows, None)
        large = self.bounds.table(rows.sparkSession).select(self.bounds.key)
        return rows.join(large, self.bounds.key, "left_anti"), rows.join(large, self.bounds.key, "left_semi")


def grid_of_bounds(spark: SparkSession, path: str, key: str, ticks_per_second: int) -> TimeGrid:
    """The grid that a written table of bounds describes. Readers of the recordings need not measure again."""
    size = F.size(STARTS).cast("long")
    found = spark.read.parquet(path).agg(F.max(size).alias("most"), F.sum(size).alias("total"), F.max(COPIES).alias("copies"))
    most, total, copies = found.first()
    if not most and not copies:
        return TimeGrid(ticks_per_second)
    return TimeGrid(ticks_per_second, None, bool(copies), SliceBounds(path, key, max(1, most), total))


def slice_bounds(
    samples: DataFrame, key: str = "container_id", time: str = "time", target_rows: int = 4_000_000
) -> DataFrame | None:
    """The table of bounds for ``samples``: recordings of more than ``target_rows`` rows, cut where as many rows lie
    between the cuts; None if there is no such recording.

    One aggregation counts the rows per recording. Only when one is above the target are the times of the large ones summed
    up, each in one mergeable quantile sketch, whose error is a quarter of a slice up to 2,000 slices a recording. Equal
    cuts are one: what is left above the target then are copies of single instants, and ``copies`` says so.
    """
    total = samples.count()
    if total <= target_rows:  # read from file statistics, where the rows come from files
        return None
    rows = samples.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time).alias("_t"))
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    largest = large.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    slices = F.ceil(F.col("_n") / target_rows)
    wanted = -(-largest // target_rows)
    accuracy = min(65_535, max(200, int((9.2 * wanted) ** 1.11)))  # rank error 2.3 / accuracy ** 0.9
    if total // target_rows <= BROADCAST_STARTS:  # no more recordings than this can be large
        large = F.broadcast(large)
    sketch = rows.join(large, key).groupBy(key, "_n").agg(F.kll_sketch_agg_bigint("_t", accuracy).alias("_sketch"))
    fine = min(MOST_CUTS, 4 * wanted)  # every recording is cut at some of these shares of its rows
    shares = F.expr(f"array({', '.join(f'{i / fine!r}D' for i in range(1, fine))})")
    sketch = sketch.select(key, slices.alias("_slices"), F.kll_sketch_get_quantile_bigint("_sketch", shares).alias("_fine"))
    ordinals = F.sequence(F.lit(1).cast("long"), F.least(F.col("_slices"), F.lit(fine)) - 1)
    nearest = F.transform(ordinals, lambda i: F.get("_fine", F.round(i * fine / F.col("_slices")).cast("int") - 1))
    cuts = sketch.select(key, nearest.alias("_cuts"))
    starts = F.array_sort(F.array_distinct("_cuts"))
    return cuts.select(key, starts.alias(STARTS), (F.size("_cuts") > F.size(F.array_distinct("_cuts"))).alias(COPIES))


def measure_grid(
    samples: DataFrame,
    ticks_per_second: int,
    key: str = "container_id",
    time: str = "time",
    target_rows: int = 4_000_000,
    folder: str | None = None,
) -> TimeGrid:
    """The grid for ``samples``; its table of bounds, if it needs one, is written to ``folder`` (else to a scratch folder)."""
    bounds = slice_bounds(samples, key, time, target_rows)
    if bounds is None:
        return TimeGrid(ticks_per_second)
    folder = folder or scratch_folder(samples.sparkSession, "slices")
    bounds.write.mode("overwrite").parquet(folder)
    return grid_of_bounds(samples.sparkSession, folder, key, ticks_per_second)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle small rows that stand for much work, such as tasks and blocks to be filled.

    With a given number of partitions the adaptive planner does not merge them, which by their few bytes it would.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *columns)

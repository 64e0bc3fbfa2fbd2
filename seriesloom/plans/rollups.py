"""Reading a report: roll-ups over recordings, validation and diagnosis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = ("bin_id", "lower_bound", "upper_bound", "bin_name")


def _scale(agg_type, ticks_per_second: int):
    return F.when(agg_type == "histogram_duration", F.lit(float(ticks_per_second))).otherwise(F.lit(1.0))


def rollup_1d(
    fact: DataFrame,
    dimension: DataFrame,
    ticks_per_second: int,
    names: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sum per bin and its share of the total in percent (0 for an empty histogram); durations in seconds."""
    dims = dimension.select("visual_id", "name", "agg_type")
    if names is not None:
        dims = dims.where(F.col("name").isin(list(names)))
    sums = (
        fact.groupBy("visual_id", *by, *BIN)
        .agg(F.sum("hist_value").alias("_raw"))
        .join(dims, "visual_id")
    )
    total = F.sum("_raw").over(Window.partitionBy("visual_id", *by))
    return sums.select(
        "name",
        *by,
        *BIN,
        (F.col("_raw") / _scale(F.col("agg_type"), ticks_per_second)).alias("hist_value"),
        F.when(total > 0, F.col("_raw") / total * 100).otherwise(F.lit(0.0)).alias("relative_pct"),
    )


def select_sessions(
    fact: DataFrame,
    sessions: DataFrame,
    vehicle: str | None = None,
    start: str | None = None,
    stop: str | None = None,
    min_km: float | None = None,
    max_km: float | None = None,
) -> DataFrame:
    """Fact rows of the recordings of a vehicle, time range or mileage range, with the vehicle beside them."""
    if vehicle is not None:
        sessions = sessions.where(F.col("vehicle_key") == vehicle)
    if start is not None:
        sessions = sessions.where(F.col("start_dt") >= F.lit(start).cast("timestamp"))
    if stop is not None:
        sessions = sessions.where(F.col("stop_dt") <= F.lit(stop).cast("timestamp"))
    if min_km is not None:
        sessions = sessions.where(F.col("start_km") >= min_km)
    if max_km is not None:
        sessions = sessions.where(F.col("end_km") <= max_km)
    return fact.join(sessions.select("container_id", "vehicle_key"), "container_id")


def rollup_2d(fact: DataFrame, dimension: DataFrame, ticks_per_second: int) -> DataFrame:
    """The dense matrix in long form: seconds per cell, zero where no recording has a row."""
    sums = fact.groupBy("visual_id", "x_bin_id", "y_bin_id").agg(F.sum("hist_value").alias("_raw"))
    last = F.lit(2)
    cells = dimension.select(
        "visual_id",
        "name",
        F.explode(F.sequence(F.lit(0), F.size("x_bins") - last)).alias("x_bin_id"),
        "y_bins",
    ).select(
        "visual_id",
        "name",
        "x_bin_id",
        F.explode(F.sequence(F.lit(0), F.size("y_bins") - last)).alias("y_bin_id"),
    )
    return cells.join(sums, ["visual_id", "x_bin_id", "y_bin_id"], "left").select(
        "name",
        "x_bin_id",
        "y_bin_id",
        (F.coalesce("_raw", F.lit(0.0)) / F.lit(float(ticks_per_second))).alias("hist_value"),
    )


def rollup_statistics(fact: DataFrame, dimension: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One number per channel and label: least min, largest max, summed count, else the mean."""
    dims = dimension.select("visual_id", "name")
    if names is not None:
        dims = dims.where(F.col("name").isin(list(names)))
    rows = fact.groupBy("visual_id", "channel_name", "aggregation_label").agg(
        F.min("statistic_value").alias("_min"),
        F.max("statistic_value").alias("_max"),
        F.sum("statistic_value").alias("_sum"),
        F.avg("statistic_value").alias("_avg"),
    )
    label = F.col("aggregation_label")
    value = (
        F.when(label == "min", F.col("_min"))
        .when(label == "max", F.col("_max"))
        .when(label == "count", F.col("_sum"))
        .otherwise(F.col("_avg"))
    )
    return rows.join(dims, "visual_id").select("name", "channel_name", "aggregation_label", value.alias("value"))


def validate_histograms(fact: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per histogram: recordings, total, non-zero bins and OK or EMPTY."""
    sums = fact.groupBy("visual_id").agg(
        F.countDistinct("container_id").alias("sessions"),
        F.sum("hist_value").alias("_total"),
        F.count_if(F.col("hist_value") > 0).alias("non_zero_bins"),
    )
    total = F.coalesce("_total", F.lit(0.0))
    return dimension.select("visual_id", "name").join(sums, "visual_id").select(
        "name",
        "sessions",
        F.round(total, 2).alias("total_value"),
        "non_zero_bins",
        F.when(total > 0, F.lit("OK")).otherwise(F.lit("EMPTY")).alias("status"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("tbl"), "cnt") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_report(tables: Mapping[str, DataFrame]) -> list[dict]:
    """Three levels, stopping at the first that fails: tables exist, tables have rows, histograms have values."""
    needed = ("histogram_dimension", "histogram_fact")
    found = {n: n in tables for n in needed}
    levels = [{"name": "Table Existence", "passed": all(found.values()), "details": found}]
    if not levels[-1]["passed"]:
        return levels
    counts = {r["tbl"]: r["cnt"] for r in row_counts({n: tables[n] for n in needed}).collect()}
    levels.append({"name": "Row Counts", "passed": all(c > 0 for c in counts.values()), "details": counts})
    if not levels[-1]["passed"]:
        return levels
    checks = validate_histograms(tables["histogram_fact"], tables["histogram_dimension"])
    seen = checks.agg(
        F.count(F.lit(1)).alias("with_rows"), F.count_if(F.col("status") == "OK").alias("with_data")
    ).first()
    defined = counts["histogram_dimension"]
    details = {"total_defined": defined, "with_data": seen["with_data"], "empty": defined - seen["with_data"]}
    levels.append({"name": "Histogram Values", "passed": seen["with_data"] > 0, "details": details})
    return levels


def histogram_summary(fact: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per histogram: recordings, rows, total, largest and least non-zero value."""
    sums = fact.groupBy("visual_id").agg(
        F.countDistinct("container_id").alias("session_count"),
        F.count(F.lit(1)).alias("bin_count"),
        F.sum("hist_value").alias("total_value"),
        F.max("hist_value").alias("max_value"),
        F.min(F.when(F.col("hist_value") > 0, F.col("hist_value"))).alias("min_nonzero_value"),
    )
    return dimension.select("visual_id", "name", "bins_unit", "values_unit").join(sums, "visual_id").drop("visual_id")


def diagnose(sessions: DataFrame, dimension: DataFrame, fact: DataFrame) -> DataFrame:
    """What the three row counts of a report mean."""
    counts = row_counts({"sessions": sessions, "histogram_dim": dimension, "histogram_fact": fact})
    wide = counts.agg(
        *[
            F.sum(F.when(F.col("tbl") == t, F.col("cnt"))).alias(t)
            for t in ("sessions", "histogram_dim", "histogram_fact")
        ]
    )
    s, d, f = F.col("sessions") > 0, F.col("histogram_dim") > 0, F.col("histogram_fact") > 0
    return wide.withColumn(
        "meaning",
        F.when(s & d & f, F.lit("processed"))
        .when(s & d, F.lit("no values"))
        .when(s, F.lit("no definitions"))
        .otherwise(F.lit("no sessions")),
    )


def missing_signals(wanted: DataFrame, channels: DataFrame, sessions: DataFrame) -> DataFrame:
    """Wanted channel names that none of the sessions' recordings has."""
    present = channels.join(sessions.select("container_id"), "container_id", "left_semi").select("channel_name")
    return wanted.join(present, "channel_name", "left_anti")


def list_aggregations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All aggregations of every kind in one list; kinds whose table is missing are left out."""
    none = F.lit("")
    kinds = {
        "histogram_dimension": ("histogram_1d", "agg_type", "bins_unit", "values_unit", None, None),
        "histogram2d_dimension": ("histogram_2d", None, None, None, "x_bins_unit", "y_bins_unit"),
        "stats_aggregator_dimension": ("statistics", None, None, None, None, None),
    }
    parts = []
    for table, (kind, agg_type, bins, values, x, y) in kinds.items():
        if table not in tables:
            continue

        def text(column):
            return F.coalesce(F.col(column), none) if column else none

        detail = F.lit("duration") if kind == "histogram_2d" else text(agg_type)
        parts.append(
            tables[table].select(
                "visual_id",
                "name",
                F.lit(kind).alias("agg_type"),
                detail.alias("type"),
                text("description").alias("description"),
                text(bins).alias("bins_unit"),
                text(values).alias("values_unit"),
                text(x).alias("x_bins_unit"),
                text(y).alias("y_bins_unit"),
            )
        )
    if not parts:
        raise LookupError("no report tables")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def array_of_text(column):
    """Array texts such as ``["a","b"]`` to arrays; anything else to an empty array."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))

"""Expected against actual report results. Histograms are matched by name, since their ids differ between reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_definitions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Which histograms exist on which side."""
    e = expected.select("name", F.col("agg_type").alias("expected_type"), F.lit(True).alias("_e"))
    a = actual.select("name", F.col("agg_type").alias("actual_type"), F.lit(True).alias("_a"))
    return e.join(a, "name", "full_outer").select(
        F.col("name").alias("histogram_name"),
        F.col("_e").isNotNull().alias("in_expected"),
        F.col("_a").isNotNull().alias("in_actual"),
        "expected_type",
        "actual_type",
    )


def verdict(deviation_pct: Column) -> Column:
    """Under 1 % MATCH, under 5 % CLOSE, up to 20 % INVESTIGATE, above or missing FAIL."""
    return (
        F.when(deviation_pct < 1, F.lit("MATCH"))
        .when(deviation_pct < 5, F.lit("CLOSE"))
        .when(deviation_pct <= 20, F.lit("INVESTIGATE"))
        .otherwise(F.lit("FAIL"))
    )


def _totals(fact: DataFrame, dimension: DataFrame, side: str) -> DataFrame:
    # The set of bins is bounded by the definition; only the recordings need a distinct count.
    per = fact.where(F.col("hist_value") > 0).groupBy("visual_id").agg(
        F.sum("hist_value").alias(f"{side}_total"),
        F.countDistinct("container_id").alias(f"{side}_sessions"),
        F.size(F.collect_set("bin_id")).cast("long").alias(f"{side}_bins_with_data"),
    )
    return dimension.select("visual_id", F.col("name").alias("histogram_name")).join(per, "visual_id").drop("visual_id")


def compare_totals(
    expected_fact: DataFrame, expected_dim: DataFrame, actual_fact: DataFrame, actual_dim: DataFrame
) -> DataFrame:
    """Totals per histogram, deviation in percent and a verdict."""
    e = _totals(expected_fact, expected_dim, "expected")
    a = _totals(actual_fact, actual_dim, "actual")
    both = e.join(a, "histogram_name", "full_outer")
    deviation = F.when(
        F.col("expected_total") > 0,
        F.round(F.abs(F.col("actual_total") - F.col("expected_total")) / F.col("expected_total") * 100, 2),
    )
    return both.withColumn("deviation_pct", deviation).withColumn("verdict", verdict(F.col("deviation_pct")))


def compare_bins(
    expected_fact: DataFrame, expected_dim: DataFrame, actual_fact: DataFrame, actual_dim: DataFrame, name: str
) -> DataFrame:
    """Per recording and bin: both values and their difference, where either has one."""
    e = expected_fact.join(expected_dim.where(F.col("name") == name).select("visual_id"), "visual_id", "left_semi")
    a = actual_fact.join(actual_dim.where(F.col("name") == name).select("visual_id"), "visual_id", "left_semi")
    keys = ["container_id", "bin_id"]
    e = e.select(*keys, "lower_bound", "upper_bound", F.col("hist_value").alias("expected_value"))
    a = a.select(*keys, F.col("hist_value").alias("actual_value"))
    diff = F.col("actual_value") - F.col("expected_value")
    return (
        e.join(a, keys, "left")
        .where((F.col("expected_value") > 0) | (F.col("actual_value") > 0))
        .select(
            F.lit(name).alias("histogram_name"),
            *keys,
            "lower_bound",
            "upper_bound",
            "expected_value",
            "actual_value",
            F.round(diff, 6).alias("abs_diff"),
            F.when(F.col("expected_value") > 0, F.round(diff / F.col("expected_value") * 100, 2)).alias("rel_diff_pct"),
        )
    )


def one_sided(expected: DataFrame, actual: DataFrame, key: str = "container_id") -> DataFrame:
    """Keys present on one side only."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    only_e = e.join(a, key, "left_anti").select(key, F.lit(True).alias("in_expected"), F.lit(False).alias("in_actual"))
    only_a = a.join(e, key, "left_anti").select(key, F.lit(False).alias("in_expected"), F.lit(True).alias("in_actual"))
    return only_e.unionByName(only_a)


def all_zero(fact: DataFrame, dimension: DataFrame) -> DataFrame:
    """Definitions without any value."""
    sums = fact.groupBy("visual_id").agg(F.sum("hist_value").alias("total")).where(F.col("total") > 0)
    return dimension.join(sums, "visual_id", "left_anti").select("name")

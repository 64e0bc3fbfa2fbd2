"""Matching channel names to a dictionary of signal families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_families(channels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Channels (``channel_name, unit, min_value, max_value``) with the signals they may be.

    ``dictionary``, of any length: ``domain, signal, patterns, units, lo, hi``; a channel fits a signal if its name holds
    one of the patterns, upper and lower case alike. Distinct names meet the distinct patterns once, and what fits is
    joined back. ``score`` counts the confirmations: the unit, and a value range inside the plausible one.
    """
    pattern = dictionary.select("domain", "signal", F.explode("patterns").alias("pattern"))
    pattern = pattern.select("domain", "signal", F.lower("pattern").alias("pattern")).where("pattern != ''").distinct()
    names = channels.select("channel_name").where("channel_name IS NOT NULL").distinct()
    # a pattern stands in a name only where its first two characters do, which gives the join a key
    gram = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("channel_name"), F.lit(1))),
            lambda i: F.lower(F.substring(F.col("channel_name"), i, F.lit(2))),
        )
    )
    grams = names.withColumn("gram", F.explode(F.array_union(gram, F.transform(gram, lambda g: F.left(g, F.lit(1))))))
    keyed = pattern.withColumn("gram", F.left("pattern", F.lit(2)))
    fits = grams.join(keyed, "gram").where(F.lower("channel_name").contains(F.col("pattern")))
    fits = fits.select("channel_name", "domain", "signal").distinct()
    rows = channels.join(fits, "channel_name").join(dictionary.drop("patterns"), ["domain", "signal"])
    unit_fits = F.coalesce(F.array_contains("units", F.col("unit")), F.lit(False))
    range_fits = F.coalesce((F.col("min_value") >= F.col("lo")) & (F.col("max_value") <= F.col("hi")), F.lit(False))
    return rows.select(
        *channels.columns,
        "domain",
        "signal",
        unit_fits.alias("unit_fits"),
        range_fits.alias("range_fits"),
        (unit_fits.cast("int") + range_fits.cast("int")).alias("score"),
    )


def search_names(channels: DataFrame, text: str) -> DataFrame:
    """Channels whose name holds the text, upper and lower case alike; all channels for an empty text."""
    wanted = text.strip().lower()
    return channels.where(F.lower("channel_name").contains(wanted)) if wanted else channels

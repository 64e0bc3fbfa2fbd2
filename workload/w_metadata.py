"""Recordings, vehicles, channels and tags."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.tags import (
    FILENAME_KEYS,
    base_name,
    comment_tags,
    filename_tags,
    signal_name,
    signal_unit,
    without_scheme,
)
from seriesloom.functions.times import micros_of, parse_timestamp, ticks_of, timestamp_of, timestamp_text
from seriesloom.plans import metadata
from seriesloom.plans.catalog import (
    VehicleFilter,
    container_filter,
    known_vehicles,
    of_run,
    rename_columns,
    session_columns,
)
from seriesloom.plans.dictionary import match_families, search_names
from seriesloom.plans.profile import AliasMap, ChannelMap, ContainerMap, Profile, SeriesMap, TagMap, VehicleRule
from workload.model import TICKS, alias_profile
from workload.registry import query
from workload.sql import sql

NS = 1_000_000_000


def ledger_of(d) -> DataFrame:
    """One file per recording, in five runs."""
    per = d.samples.select("container_id", "vehicle_key").distinct()
    run = F.col("container_id") % 5
    status = F.when(run == 0, F.lit("succeeded")).when(run <= 2, F.lit("failed")).otherwise(F.lit("unprocessed"))
    return per.select(
        "container_id",
        F.concat(F.lit("run_"), run.cast("string")).alias("run_id"),
        F.concat_ws("/", F.lit("rec"), "vehicle_key", F.concat(F.col("container_id").cast("string"), F.lit(".dat"))).alias(
            "filename"
        ),
        status.alias("status"),
        F.timestamp_micros(F.lit(1706745600000000) + run * 3600000000).alias("_load_ts"),
        F.lit(None).cast("timestamp").alias("_processing_done_ts"),
    )


def times_as_micros(df: DataFrame) -> DataFrame:
    """Timestamps as whole numbers, which every engine compares alike."""
    return df.withColumns({n: F.unix_micros(n) for n, t in df.dtypes if t == "timestamp"})


# -- derived metrics and tags ----------------------------------------------------------------------------------------
@query(
    "a1_channel_metrics",
    sql(
        """SELECT container_id, channel_id, sample_count, min, max, round(mean, 6) AS mean, begin_ticks, end_ticks, duration_ticks,
  round(sample_rate * 3600, 6) AS sample_rate, 'DOUBLE' AS value_type FROM chm"""
    ),
)
def _(d):
    m = metadata.channel_metrics(d.samples, TICKS)
    return m.withColumn("mean", F.round("mean", 6)).withColumn("sample_rate", F.round(F.col("sample_rate") * 3600, 6))


@query(
    "a2_channel_tags",
    sql(
        """SELECT container_id, channel_id, 'channel_name' AS key, channel_name AS value FROM chm
UNION ALL SELECT container_id, channel_id, 'unit', unit FROM chm
UNION ALL SELECT container_id, channel_id, 'vehicle_key', 'veh_' || (container_id % 7) FROM chm"""
    ),
)
def _(d):
    return metadata.channel_tags(d.samples, ["channel_name", "unit", "vehicle_key"])


@query(
    "a3_container_metrics",
    sql(
        """SELECT container_id, vehicle_key, lo // 1000 AS start_ts, hi // 1000 AS stop_ts, lo AS start_dt, hi AS stop_dt,
  hi // 1000 - lo // 1000 AS duration_ms, num_channels FROM cm"""
    ),
)
def _(d):
    return times_as_micros(d.container_metrics)


@query(
    "a4_path_tags",
    """WITH f AS (SELECT page_id AS container_id, url, html FROM pages)
SELECT container_id, 'file_uri' AS key, url AS value FROM f
UNION ALL SELECT container_id, 'base_uri', regexp_extract(url, '^(.*)/[^/]*$', 1) FROM f
UNION ALL SELECT container_id, 'filename', list_last(string_split(url, '/')) FROM f""",
)
def _(d):
    files = d.table("pages").select(F.col("page_id").alias("container_id"), F.col("url").alias("filename"))
    return metadata.path_tags(files)


@query(
    "a5_vehicle_candidates",
    sql("SELECT vehicle_key AS vehicle_id, count(DISTINCT container_id) AS container_count FROM bronze WHERE vehicle_key <> 'NA' GROUP BY vehicle_key"),
)
def _(d):
    return d.catalog().vehicle_candidates()


@query(
    "a5_vehicle_candidates_by_rule",
    sql(
        """SELECT 'column' AS rule, vehicle_key AS vehicle_id, count(*) AS container_count FROM cm GROUP BY vehicle_key
UNION ALL SELECT 'constant', 'fleet_a', count(*) FROM cm"""
    ),
)
def _(d):
    out = None
    for rule in (VehicleRule("column", column="vehicle_key"), VehicleRule("constant", constant="fleet_a")):
        profile = Profile(vehicle=rule, tags=TagMap(container_table=None), ticks_per_second=TICKS)
        part = d.catalog(profile).vehicle_candidates().withColumn("rule", F.lit(rule.source))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a6_vehicle_volume",
    sql("SELECT vehicle_key AS vehicle_id, count(*) AS session_count, min(lo) AS first_data, max(hi) AS last_data FROM cm GROUP BY vehicle_key"),
)
def _(d):
    return times_as_micros(d.catalog().vehicle_volume())


@query(
    "a7_channel_catalog",
    sql(
        """SELECT channel_name, unit, sum(sample_count)::BIGINT AS sample_count, min(min) AS min_value, max(max) AS max_value,
  round(avg(mean), 6) AS mean_value, round(avg(sample_rate) * 3600, 6) AS sample_rate, count(DISTINCT container_id) AS container_count
FROM chm GROUP BY channel_name, unit"""
    ),
)
def _(d):
    return _catalog_rounded(d.catalog().channel_catalog())


def _catalog_rounded(df):
    return df.withColumn("mean_value", F.round("mean_value", 6)).withColumn(
        "sample_rate", F.round(F.col("sample_rate") * 3600, 6)
    )


# -- profile and projections -----------------------------------------------------------------------------------------
def mapped_profile() -> Profile:
    """A source with its own names and time unit: the samples as they are, times in ns by an expression."""
    return Profile(
        containers=ContainerMap(id="container_id", start="timestamp_micros(start_ts * 1000)", stop="stop_dt"),
        channels=ChannelMap(sample_rate="sample_count / (duration_ticks / 1e6)"),
        series=SeriesMap(
            table="raw_samples",
            time="unix_micros(cast(ts as timestamp)) * 1000",
            end=None,
            value="value / 10",
            container_match="user_id",
            channel_match="concat('ch_', event_type)",
        ),
        ticks_per_second=NS,
    )


@query(
    "p1_profile_projection",
    sql("SELECT container_id, 'ch_' || channel_name AS channel_id, time * 1000 AS tstart, value / 10 AS value FROM bronze"),
)
def _(d):
    catalog = d.catalog(mapped_profile())
    catalog.tables["raw_samples"] = d.table("events")
    return catalog.series()


@query(
    "p2_profile_overrides",
    sql("SELECT container_id, channel_id, tstart, tend, value * 2 AS value FROM runs"),
)
def _(d):
    base = Profile(ticks_per_second=TICKS)
    changed = base.override_source({"series.value": "value * 2", "series.time": None, "vehicle.column": "x"})
    return d.catalog(changed).series()


@query(
    "p4_container_tags_made_up",
    sql(
        """SELECT container_id, 'filename' AS key, container_id::VARCHAR AS value FROM cm
UNION ALL SELECT container_id, 'vehicle_key', vehicle_key FROM cm"""
    ),
)
def _(d):
    rule = VehicleRule("column", column="vehicle_key")
    return d.catalog(Profile(vehicle=rule, tags=TagMap(container_table=None))).container_tags()


@query(
    "p5_channel_tags_made_up",
    sql(
        """SELECT container_id, channel_id, 'channel_name' AS key, channel_name AS value FROM chm
UNION ALL SELECT container_id, channel_id, 'unit', unit FROM chm"""
    ),
)
def _(d):
    own_unit = Profile(channels=ChannelMap(unit="unit"), tags=TagMap(channel_table=None))
    return d.catalog(own_unit).channel_tags()


@query(
    "j4_unit_by_alias",
    sql(
        """SELECT container_id, channel_id, 'channel_name' AS key, channel_name AS value FROM chm
UNION ALL SELECT c.container_id, c.channel_id, 'unit', coalesce(u.unit, '')
FROM chm c LEFT JOIN (SELECT DISTINCT channel_name, unit FROM aliases WHERE channel_name <> 'view') u USING (channel_name)"""
    ),
)
def _(d):
    catalog = d.catalog(alias_profile(tags=TagMap(channel_table=None)))
    units = d.aliases.select("channel_name", "unit").where(F.col("channel_name") != "view").distinct()
    catalog.tables["aliases"] = units
    return catalog.channel_tags()


@query(
    "p6_container_filter",
    sql(
        """SELECT container_id, vehicle_key FROM cm WHERE
  (vehicle_key = 'veh_1' AND lo >= epoch_us(TIMESTAMP '2024-01-01 12:00:00') AND hi <= epoch_us(TIMESTAMP '2024-01-30 20:00:00') AND (hi // 1000 - lo // 1000) / 1000.0 <= 2592000)
  OR (vehicle_key = 'veh_2' AND lo >= epoch_us(TIMESTAMP '1980-01-01 00:00:00') AND (hi // 1000 - lo // 1000) / 1000.0 <= 2500000)
  OR (vehicle_key = 'veh_3' AND (hi // 1000 - lo // 1000) / 1000.0 <= 259200)"""
    ),
)
def _(d):
    rows = d.container_metrics.withColumn("duration_s", F.col("duration_ms") / 1000)
    vehicles = [
        VehicleFilter("veh_1", "2024-01-01 12:00:00", "2024-01-30 20:00:00", 2_592_000),
        VehicleFilter("veh_2", "1980-01-01 00:00:00", None, 2_500_000),
        VehicleFilter("veh_3", max_seconds=259_200),  # three days, where a configuration sets no other limit
    ]
    return rows.where(container_filter(vehicles)).select("container_id", "vehicle_key")


@query("p7_run_filter", sql("SELECT container_id, channel_id, time, value FROM bronze WHERE container_id % 5 = 3"))
def _(d):
    rows = d.samples.select("container_id", "channel_id", "time", "value")
    return of_run(rows, ledger_of(d), "run_3")


@query(
    "p8_known_vehicles",
    sql("SELECT container_id, nullif(replace(vehicle_key, 'veh_0', 'NA'), 'veh_1') AS vehicle_key FROM cm WHERE vehicle_key NOT IN ('veh_0', 'veh_1')"),
)
def _(d):
    key = F.col("vehicle_key")
    rows = d.container_metrics.select(
        "container_id", F.when(key == "veh_0", "NA").when(key != "veh_1", key).alias("vehicle_key")
    )
    return known_vehicles(rows, "vehicle_key")


@query(
    "p9_alias_search",
    sql(
        """SELECT channel_alias_name, channel_name, channel_name AS signal, '' AS device_name, NULL::VARCHAR AS network, unit, description
FROM aliases WHERE channel_alias_name LIKE '%ew%' OR channel_name LIKE '%ew%' ORDER BY channel_alias_name"""
    ),
)
def _(d):
    return d.catalog(alias_profile()).alias_search("ew")


@query("p10_name_search", "SELECT p_partkey, p_name AS channel_name FROM part WHERE lower(p_name) LIKE '%widget%'")
def _(d):
    parts = d.table("part").select("p_partkey", F.col("p_name").alias("channel_name"))
    return search_names(parts, " WidGet ")


@query(
    "p13_valid_numbers",
    sql(
        """SELECT container_id, time, CASE WHEN value > 100 THEN 'nan'::DOUBLE ELSE value END AS value
FROM bronze WHERE channel_name <> 'signup'"""
    ),
)
def _(d):
    raw = F.when(F.col("channel_name") == "signup", F.lit("on")).otherwise(F.col("value").cast("string"))
    rows = d.samples.select("container_id", "time", raw.alias("raw"), (F.col("value") > 100).alias("invalid"))
    return metadata.valid_numbers(rows)


@query(
    "p14_plausible_values",
    sql(
        """SELECT container_id, channel_name, time, value FROM bronze b LEFT JOIN
  (SELECT channel_name, round(avg(value)) AS hi FROM bronze WHERE channel_name <> 'view' GROUP BY channel_name) r USING (channel_name)
WHERE hi IS NULL OR value BETWEEN 5 AND hi"""
    ),
)
def _(d):
    rows = d.samples.select("container_id", "channel_name", "time", "value")
    known = rows.where(F.col("channel_name") != "view")
    ranges = known.groupBy("channel_name").agg(F.lit(5.0).alias("lo"), F.round(F.avg("value")).alias("hi"))
    return metadata.plausible(rows, ranges)


@query(
    "p15_session_columns",
    sql("SELECT container_id, vehicle_key, lo // 1000 AS start_ts, (lo // 1000)::DOUBLE AS start_number, container_id::VARCHAR AS session_name FROM cm"),
)
def _(d):
    casts = [("start_ts", "start_number", "double"), ("container_id", "session_name", "string")]
    return session_columns(d.container_metrics, ["container_id", "vehicle_key", "start_ts"], casts)


@query("p16_rename_map", "SELECT user_id AS container_id, event_type AS channel_id, epoch_us(ts) AS tstart, value FROM events")
def _(d):
    profile = Profile(
        channels=ChannelMap(container_id="user_id", id="event_type"), series=SeriesMap(time="ts_us", end=None)
    )
    rows = d.table("events").select("user_id", "event_type", micros_of(F.col("ts")).alias("ts_us"), "value")
    return rename_columns(rows, profile.renames()["channels"])


@query(
    "p21_channel_lookup",
    sql(
        """SELECT 'tags' AS by_what, container_id, channel_id FROM chm WHERE channel_name = 'click' AND unit = 'rpm'
UNION ALL SELECT 'alias', container_id, channel_id FROM chm WHERE channel_name = 'view'"""
    ),
)
def _(d):
    catalog = d.catalog(alias_profile())
    tags = catalog.channels_matching(channel_name="click", unit="rpm").withColumn("by_what", F.lit("tags"))
    alias = catalog.channels_matching(channel_alias_name="view_veh_1").withColumn("by_what", F.lit("alias"))
    return tags.unionByName(alias)


# -- joins -----------------------------------------------------------------------------------------------------------
@query(
    "j1_container_list",
    sql(
        """SELECT container_id, coalesce(vehicle_key, '') AS vehicle_key, lo AS start_dt, hi AS stop_dt, num_channels::BIGINT AS num_channels,
  hi // 1000 - lo // 1000 AS duration_ms FROM cm"""
    ),
)
def _(d):
    return times_as_micros(d.catalog().containers_list())


@query(
    "j2_signal_list",
    sql(
        """SELECT channel_id, channel_name, unit, sample_count, min, max, round(mean, 6) AS mean, round(sample_rate * 3600, 6) AS sample_rate
FROM chm WHERE container_id = 3"""
    ),
)
def _(d):
    rows = d.catalog().signals_list(3)
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("sample_rate", F.round(F.col("sample_rate") * 3600, 6))


@query(
    "j3_channel_catalog_of_vehicles",
    sql(
        """SELECT channel_name, unit, sum(sample_count)::BIGINT AS sample_count, min(min) AS min_value, max(max) AS max_value,
  round(avg(mean), 6) AS mean_value, round(avg(sample_rate) * 3600, 6) AS sample_rate, count(DISTINCT container_id) AS container_count
FROM chm WHERE container_id % 7 IN (1, 4) GROUP BY channel_name, unit"""
    ),
)
def _(d):
    return _catalog_rounded(d.catalog().channel_catalog(["veh_1", "veh_4"]))


@query("j5_data_time_range", sql("SELECT min(lo) AS min_start, max(hi) AS max_stop FROM cm WHERE vehicle_key IN ('veh_1', 'veh_4')"))
def _(d):
    return times_as_micros(d.catalog().data_time_range(["veh_1", "veh_4"]))


@query(
    "j8_vehicle_channels",
    sql("SELECT DISTINCT channel_name, unit, sample_count, min AS min_value, max AS max_value FROM chm WHERE container_id % 7 = 2"),
)
def _(d):
    return d.catalog().vehicle_channels("veh_2")


@query(
    "k1_newest_containers_first",
    sql("SELECT container_id, lo AS start_us FROM cm ORDER BY lo DESC, container_id"),
)
def _(d):
    rows = d.catalog().containers().orderBy(F.desc("start_dt"), "container_id")
    return rows.select("container_id", F.unix_micros("start_dt").alias("start_us"))


@query("k3_limited_alias_search", sql("SELECT channel_alias_name, channel_name FROM aliases WHERE channel_alias_name LIKE '%e%' OR channel_name LIKE '%e%' ORDER BY channel_alias_name LIMIT 7"))
def _(d):
    return d.catalog(alias_profile()).alias_search("e", limit=7).select("channel_alias_name", "channel_name")


@query(
    "u1_union_of_tags",
    sql(
        """SELECT container_id, key, count(*) AS n FROM (SELECT container_id, 'vehicle_key' AS key FROM cm
UNION ALL SELECT container_id, unnest(['channel_name', 'unit']) FROM chm) GROUP BY container_id, key"""
    ),
)
def _(d):
    catalog = d.catalog()
    tags = catalog.container_tags().select("container_id", "key")
    tags = tags.unionByName(catalog.channel_tags().select("container_id", "key"))
    return tags.groupBy("container_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query("u2_distinct_channels", sql("SELECT DISTINCT vehicle_key, channel_name, unit FROM bronze"))
def _(d):
    return d.samples.select("vehicle_key", "channel_name", "unit").distinct()


@query(
    "j18_merge_metadata",
    sql(
        """SELECT container_id, 'vehicle_key' AS key, CASE WHEN container_id % 2 = 0 THEN 'moved' ELSE vehicle_key END AS value
FROM cm WHERE container_id % 3 <> 0 OR container_id % 2 = 0"""
    ),
)
def _(d):
    from seriesloom.sources.tables import upsert

    tags = d.catalog().container_tags()
    old = tags.where(F.col("container_id") % 3 != 0)
    new = tags.where(F.col("container_id") % 2 == 0).withColumn("value", F.lit("moved"))
    return upsert(old, new, ["container_id", "key"])


# -- scalar functions ------------------------------------------------------------------------------------------------
@query(
    "x1_comment_tags",
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'NA') AS k, event_type AS brand, 'NA' AS model FROM events""",
)
def _(d):
    text = F.concat(
        F.lit("<HDcomment><TX>{'brand': '"),
        F.col("event_type"),
        F.lit("', "),
        F.regexp_replace(F.expr("substring(props, 2)"), '"', "'"),
        F.lit("</TX></HDcomment>"),
    )
    tags = comment_tags(text, ("k", "brand", "model"))
    return d.table("events").select("event_id", tags.alias("t")).select("event_id", "t.*")


@query(
    "x2_filename_tags",
    sql(
        """SELECT container_id, '2024-01-' || lpad((container_id % 28 + 1)::VARCHAR, 2, '0') AS date, 'brand' || (container_id % 3) AS brand,
  vehicle_key AS model, 'rome' AS from_city, 'oslo' AS to_city, 'wet' AS condition FROM (SELECT container_id, 'm' || (container_id % 7) AS vehicle_key FROM cm)"""
    ),
)
def _(d):
    c = F.col("container_id")
    day = F.lpad((c % 28 + 1).cast("string"), 2, "0")
    name = F.concat_ws(
        "_",
        F.concat(F.lit("2024-01-"), day),
        F.concat(F.lit("brand"), (c % 3).cast("string")),
        F.concat(F.lit("m"), (c % 7).cast("string")),
        F.lit("rome"),
        F.lit("oslo"),
        F.lit("wet"),
        F.lit("extra.csv"),
    )
    path = without_scheme(F.concat(F.lit("file:/data/"), name), "file")
    rows = d.samples.select("container_id").distinct()
    return rows.select("container_id", filename_tags(base_name(path), FILENAME_KEYS).alias("t")).select(
        "container_id", "t.*"
    )


@query(
    "x3_name_unit_split",
    "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'C' WHEN p_size % 3 = 1 THEN 'km/h' ELSE '' END AS unit FROM part",
)
def _(d):
    kind = F.col("p_size") % 3
    header = F.concat(
        "p_name", F.when(kind == 0, F.lit(" [°C]")).when(kind == 1, F.lit(" [x] [km/h]")).otherwise(F.lit(""))
    )
    return d.table("part").select("p_partkey", signal_name(header).alias("name"), signal_unit(header).alias("unit"))


@query(
    "x4_ticks_timestamp_roundtrip",
    """SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text,
  epoch_us(date_trunc('minute', ts)) AS parsed FROM events""",
)
def _(d):
    ts = F.col("ts").cast("timestamp")
    ns = ticks_of(ts, NS)
    rows = d.table("events").select(
        "event_id",
        ns.alias("ns"),
        F.unix_micros(timestamp_of(ns, NS)).alias("us"),
        timestamp_text(ts).alias("text"),
        F.unix_micros(parse_timestamp(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))).alias("parsed"),
    )
    return rows


# -- dictionary ------------------------------------------------------------------------------------------------------
@query(
    "v4_dictionary_match",
    """WITH c AS (SELECT p_name, p_type AS unit, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY ALL),
words AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS pattern FROM part),
kinds AS (SELECT p_brand, list(DISTINCT p_type) AS units, min(p_retailprice) AS lo, quantile_disc(p_retailprice, 0.5) AS hi FROM part GROUP BY p_brand)
SELECT DISTINCT p_name AS channel_name, c.unit, 'part' AS domain, p_brand AS signal, list_contains(units, c.unit) AS unit_fits,
  c.lo >= kinds.lo AND c.hi <= kinds.hi AS range_fits, list_contains(units, c.unit)::INTEGER + (c.lo >= kinds.lo AND c.hi <= kinds.hi)::INTEGER AS score
FROM c JOIN words ON contains(lower(p_name), lower(pattern)) JOIN kinds USING (p_brand)""",
)
def _(d):
    """The dictionary is made from the parts too: a brand is a signal, the words of its part names are its patterns."""
    part = d.table("part")
    words = part.select("p_brand", F.explode(F.split("p_name", " ")).alias("pattern"))
    patterns = words.groupBy("p_brand").agg(F.collect_set("pattern").alias("patterns"))
    kinds = part.groupBy("p_brand").agg(
        F.collect_set("p_type").alias("units"),
        F.min("p_retailprice").alias("lo"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_retailprice)").alias("hi"),
    )
    dictionary = patterns.join(kinds, "p_brand").withColumnRenamed("p_brand", "signal").withColumn("domain", F.lit("part"))
    channels = (
        d.table("part")
        .groupBy(F.col("p_name").alias("channel_name"), F.col("p_type").alias("unit"))
        .agg(F.min("p_retailprice").alias("min_value"), F.max("p_retailprice").alias("max_value"))
    )
    return match_families(channels, dictionary).drop("min_value", "max_value")

"""Files, ledgers, decoding, table maintenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.tags import base_name
from seriesloom.operators.grid import spread
from seriesloom.plans.ingest import IngestJob
from seriesloom.sources import tables as T
from seriesloom.sources.ledger import LEDGER, mark_run, next_run
from seriesloom.sources.recordings import (
    assign_bins,
    attach_containers,
    list_channels,
    number_channels,
    read_bins,
    replicate,
    split_channels,
    wide_to_samples,
)
from seriesloom.sources.scratch import scratch_folder
from seriesloom.streaming.discover import discover
from workload.recording_file import RecordingDecoder, recording_channels, write_recording
from workload.registry import query
from workload.sql import sql
from workload.w_metadata import ledger_of, times_as_micros

SAMPLE = "container_id, channel_id, time, value"
COLUMNS = ["container_id", "channel_id", "time", "value"]


# -- ledger ----------------------------------------------------------------------------------------------------------
@query(
    "s1_discover_files",
    "SELECT 'events.parquet' AS file, 'unprocessed' AS status, count(*) AS n_samples, count(DISTINCT user_id) AS n_recordings FROM events",
)
def _(d):
    """Ledger of the table files of the folder, found by the bounded stream in micro-batches of four, and what the sample
    files among them hold."""
    folder = scratch_folder(d.spark, "discover")
    for _ in range(2):  # the second call finds nothing new
        discover(d.spark, d.folder, f"{folder}/ledger", f"{folder}/checkpoint", max_files=4, pattern="*.parquet")
    ledger = d.spark.read.parquet(f"{folder}/ledger")
    found = ledger.select(base_name(F.col("filename")).alias("file"), "status")
    held = d.table("events").select(base_name(F.input_file_name()).alias("file"), "user_id")
    held = held.groupBy("file").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("user_id").alias("n_recordings"))
    return found.join(held, "file")


@query(
    "s2_create_ledger",
    sql("SELECT container_id, run_id, filename, status, load_us AS _load_ts, NULL::BIGINT AS _processing_done_ts FROM ledger"),
)
def _(d):
    ledger = T.VersionedTable(d.spark, scratch_folder(d.spark, "ledger"))
    ledger.create(LEDGER)
    ledger.create(LEDGER)  # a second call leaves the table as it is
    ledger.upsert(ledger_of(d), ["filename", "run_id"])
    return times_as_micros(ledger.read())


@query(
    "s3_next_run",
    sql(
        """SELECT CASE WHEN count(DISTINCT run_id) FILTER (status = 'failed') > 0 THEN 'redo_failed' ELSE 'process' END AS decision,
  arg_max(run_id, load_us) FILTER (status = 'failed') AS run_id FROM ledger
UNION ALL SELECT 'process', arg_min(run_id, load_us) FROM ledger WHERE status = 'unprocessed'"""
    ),
)
def _(d):
    ledger = ledger_of(d)
    return next_run(ledger).unionByName(next_run(ledger.where(F.col("status") != "failed")))


@query(
    "k2_first_and_last_run",
    sql("SELECT status, arg_min(run_id, load_us) AS first_run, arg_max(run_id, load_us) AS last_run FROM ledger GROUP BY status"),
)
def _(d):
    rows = ledger_of(d).groupBy("status")
    return rows.agg(F.min_by("run_id", "_load_ts").alias("first_run"), F.max_by("run_id", "_load_ts").alias("last_run"))


@query(
    "s4_mark_run",
    sql(
        """SELECT container_id, run_id, filename, CASE run_id WHEN 'run_3' THEN 'succeeded' WHEN 'run_1' THEN 'in_progress' ELSE status END AS status,
  load_us AS _load_ts, CASE WHEN run_id = 'run_3' THEN 1706800000000000 END AS _processing_done_ts FROM ledger"""
    ),
)
def _(d):
    done = mark_run(ledger_of(d), "run_3", "succeeded", F.timestamp_micros(F.lit(1706800000000000)))
    return times_as_micros(mark_run(done, "run_1", "in_progress"))


# -- upserts ---------------------------------------------------------------------------------------------------------
def two_versions(d) -> tuple[DataFrame, DataFrame]:
    """Metrics of two thirds of the recordings, and newer ones of every second recording."""
    metrics = d.channel_metrics.select("container_id", "channel_id", "sample_count", "min", "max")
    old = metrics.where(F.col("container_id") % 3 != 0)
    new = metrics.where(F.col("container_id") % 2 == 0).withColumn("sample_count", F.col("sample_count") + 1000)
    return old, new.withColumn("min", F.col("min") - 1)


@query(
    "s5_upsert_columns",
    sql(
        """SELECT container_id, channel_id, CASE WHEN container_id % 2 = 0 THEN sample_count + 1000 ELSE sample_count END AS sample_count,
  CASE WHEN container_id % 3 = 0 THEN min - 1 ELSE min END AS min, max FROM chm WHERE container_id % 3 <> 0 OR container_id % 2 = 0"""
    ),
)
def _(d):
    old, new = two_versions(d)
    return T.upsert(old, new, ["container_id", "channel_id"], ["sample_count"])


@query(
    "s6_upsert_rows",
    sql(
        """SELECT container_id, channel_id, CASE WHEN container_id % 2 = 0 THEN sample_count + 1000 ELSE sample_count END AS sample_count,
  CASE WHEN container_id % 2 = 0 THEN min - 1 ELSE min END AS min, max FROM chm WHERE container_id % 3 <> 0 OR container_id % 2 = 0"""
    ),
)
def _(d):
    table = T.VersionedTable(d.spark, scratch_folder(d.spark, "metrics"))
    old, new = two_versions(d)
    table.write(old)
    table.upsert(new, ["container_id", "channel_id"])
    return table.read()


# -- recordings ------------------------------------------------------------------------------------------------------
def recordings_folder(d) -> str:
    """The samples written as one file per recording."""
    if "recordings" not in d.memo:
        folder = scratch_folder(d.spark, "recordings")
        d.spark.range(0).write.parquet(folder)  # makes the folder, wherever it is

        def write(batches):
            for batch in batches:
                paths = [f"{folder}/{c}.rec" for c in batch["container_id"]]
                for path, channels in zip(paths, batch["channels"], strict=True):
                    write_recording(path, list(channels))
                yield pd.DataFrame({"container_id": batch["container_id"], "filename": paths})

        tags = F.format_string("{'brand': 'brand%d', 'vehicle_key': '%s'}", F.col("container_id") % 3, F.min("vehicle_key"))
        samples = F.array_sort(F.collect_list(F.struct("time", "value")))
        rows = spread(d.samples, "container_id").groupBy("container_id", "channel_name")
        rows = rows.agg(F.min("unit").alias("unit"), tags.alias("comment"), samples.alias("s"))
        channel = F.struct(F.col("channel_name").alias("name"), "unit", "comment", F.col("s.time").alias("time"), F.col("s.value").alias("value"))
        rows = rows.groupBy("container_id").agg(F.array_sort(F.collect_list(channel)).alias("channels"))
        files = rows.mapInPandas(write, "container_id bigint, filename string")
        d.memo["recording files"] = scratch_folder(d.spark, "recording-files")
        files.write.parquet(d.memo["recording files"])
        d.memo["recordings"] = folder
    return d.memo["recordings"]


def recordings_of(d) -> DataFrame:
    """The paths of the recording files with their recording."""
    recordings_folder(d)
    return d.spark.read.parquet(d.memo["recording files"])


def ingest_job(d) -> IngestJob:
    """The job over all recordings, done."""
    if "ingest" not in d.memo:
        folder = scratch_folder(d.spark, "ingest")
        job = IngestJob(d.spark, folder, recording_channels, RecordingDecoder(), 1_000_000, 1000, pattern="*.rec")
        job.run(recordings_folder(d))
        d.memo["ingest"] = job
    return d.memo["ingest"]


@query(
    "s9_ingest_job",
    sql("SELECT container_id, channel_name, tstart, tend, value FROM runs"),
)
def _(d):
    """The recordings from discovery to runs by one job; its second call finds nothing to do."""
    job = ingest_job(d)
    job.run(recordings_folder(d))
    recording = F.regexp_extract("filename", "([0-9]+)[.]rec$", 1).cast("long").alias("recording")
    names = job.table("channels").select("container_id", "channel_id", "channel_name", recording)
    rows = job.table("silver").join(names, ["container_id", "channel_id"])
    return rows.select(F.col("recording").alias("container_id"), "channel_name", "tstart", "tend", "value")


@query(
    "s7_enumerate_channels",
    sql(
        """SELECT container_id, channel_name, sample_count::BIGINT AS sample_count,
  (row_number() OVER (PARTITION BY container_id ORDER BY channel_name))::INTEGER AS channel_id FROM chm"""
    ),
)
def _(d):
    files = recordings_of(d)
    channels = number_channels(list_channels(files, recording_channels))
    return attach_containers(channels, files).select("container_id", "channel_name", "sample_count", "channel_id")


PIECES, BIN = 8, 50


@query(
    "s8_balance_bins",
    sql(
        f"""SELECT container_id, channel_id, first_sample, n_samples, shard, coalesce(sum(n_samples) OVER (PARTITION BY shard
  ORDER BY container_id, channel_id, first_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {BIN} AS bin
FROM (SELECT container_id, channel_id, piece * {PIECES} AS first_sample, least({PIECES}, sample_count - piece * {PIECES})::BIGINT AS n_samples,
  (container_id % 4)::BIGINT AS shard
FROM (SELECT *, unnest(range((sample_count - 1) // {PIECES} + 1)) AS piece FROM chm))"""
    ),
)
def _(d):
    counts = d.samples.groupBy("container_id", "channel_id").agg(F.count(F.lit(1)).alias("sample_count"))
    tasks = split_channels(counts, PIECES)
    tasks = tasks.withColumn("filename", F.lpad(F.col("container_id").cast("string"), 20, "0"))
    bins = assign_bins(tasks, BIN, F.col("container_id") % 4)
    return bins.select("container_id", "channel_id", "first_sample", "n_samples", "shard", "bin")


@query(
    "s9_decode_recordings",
    sql(
        """SELECT container_id, chm.channel_id, 0 AS group_idx, chm.channel_id - 1 AS channel_idx, bronze.channel_name, bronze.unit, vehicle_key,
  'brand' || (container_id % 3) AS brand, 'NA' AS from_city, time, value
FROM bronze JOIN (SELECT container_id, channel_name, (row_number() OVER (PARTITION BY container_id ORDER BY channel_name))::INTEGER AS channel_id
  FROM chm) AS chm USING (container_id, channel_name)"""
    ),
)
def _(d):
    files = recordings_of(d)
    channels = attach_containers(number_channels(list_channels(files, recording_channels)), files)
    bins = assign_bins(split_channels(channels, 1_000_000), 1_000_000, F.pmod(F.xxhash64("filename"), F.lit(64)))
    return read_bins(bins, RecordingDecoder()).select(
        "container_id", "channel_id", "group_idx", "channel_idx", "channel_name", "unit", "vehicle_key", "brand", "from_city", "time", "value"
    )


@query(
    "s9_ingest_tags",
    sql(
        """SELECT 'channel' AS kind, container_id, key, value, count(*) AS n FROM (SELECT container_id, unnest([
    {'key': 'unit', 'value': unit}, {'key': 'channel_name', 'value': channel_name}, {'key': 'brand', 'value': 'brand' || (container_id % 3)},
    {'key': 'condition', 'value': 'NA'}], recursive := true) FROM chm) GROUP BY ALL
UNION ALL SELECT 'container', container_id, key, value, 1 FROM (SELECT container_id, unnest([
    {'key': 'filename', 'value': container_id || '.rec'}, {'key': 'vehicle_key', 'value': vehicle_key}, {'key': 'model', 'value': 'NA'}], recursive := true) FROM cm)"""
    ),
)
def _(d):
    """What the ingest job says about channels and recordings."""
    job = ingest_job(d)
    name = job.table("container_tags").where("key = 'filename'")
    name = name.select("container_id", F.regexp_extract("value", "([0-9]+)[.]rec$", 1).cast("long").alias("recording"))
    wanted = {"channel": ("unit", "channel_name", "brand", "condition"), "container": ("filename", "vehicle_key", "model")}
    parts = [
        job.table(f"{kind}_tags").where(F.col("key").isin(*keys)).select(F.lit(kind).alias("kind"), "container_id", "key", "value")
        for kind, keys in wanted.items()
    ]
    rows = parts[0].unionByName(parts[1]).join(name, "container_id")
    return rows.groupBy("kind", F.col("recording").alias("container_id"), "key", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j17_file_to_container",
    sql("SELECT container_id, count(*) AS n FROM bronze GROUP BY container_id"),
)
def _(d):
    ledger = ledger_of(d)
    named = d.samples.select(
        F.concat_ws(
            "/", F.lit("rec"), "vehicle_key", F.concat(F.col("container_id").cast("string"), F.lit(".dat"))
        ).alias("filename")
    )
    return attach_containers(named, ledger).groupBy("container_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s10_wide_recordings",
    """WITH w AS (SELECT l_orderkey, epoch_us(TIMESTAMP '2024-03-01' + INTERVAL (l_linenumber) MINUTE) AS time, l_quantity AS q,
  CASE WHEN l_discount < 0.09 THEN l_discount END AS t, l_tax AS x FROM lineitem)
SELECT l_orderkey, 'Quantity' AS channel_name, 'pcs' AS unit, time, q AS value FROM w WHERE t IS NOT NULL
UNION ALL SELECT l_orderkey, 'Oil temp', 'C', time, t FROM w WHERE t IS NOT NULL
UNION ALL SELECT l_orderkey, 'Plain', '', time, x FROM w WHERE t IS NOT NULL""",
)
def _(d):
    lines = d.table("lineitem")
    wide = lines.select(
        "l_orderkey",
        F.lit("2024-03-01").alias("date"),
        F.concat(F.lit("00:"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":00")).alias("Time"),
        F.col("l_quantity").alias("Quantity [pcs]"),
        F.when(F.col("l_discount") < 0.09, F.col("l_discount")).alias("Oil temp [°C]"),
        F.col("l_tax").alias("Plain"),
    )
    folder = scratch_folder(d.spark, "wide")
    wide.write.option("header", True).csv(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields)
    read = d.spark.read.option("header", True).schema(schema).csv(folder)
    return wide_to_samples(read, ["l_orderkey"])


@query(
    "s11_replicate",
    sql(
        """SELECT container_id, channel_id, time - lo + copy * last AS time, value FROM (SELECT b.container_id, channel_id, time, value, lo, hi - lo AS last
  FROM bronze b JOIN cm USING (container_id)), (SELECT unnest([0, 1, 2, 3]) AS copy)"""
    ),
)
def _(d):
    """Times counted from the start of the recording, then three shifted copies."""
    start = d.samples.groupBy("container_id").agg(F.min("time").alias("lo"))
    rows = d.samples.join(start, "container_id").withColumn("time", F.col("time") - F.col("lo")).select(*COLUMNS)
    return replicate(rows, 3, d.grid)


# -- table maintenance -----------------------------------------------------------------------------------------------
@query("s12_clustered_write", sql(f"SELECT {SAMPLE} FROM bronze"))
def _(d):
    folder = scratch_folder(d.spark, "clustered")
    T.clustered(d.samples.select(*COLUMNS), ["container_id", "channel_id", "time"]).write.parquet(folder)
    return d.spark.read.parquet(folder)


@query(
    "s13_roll_back",
    sql(
        """SELECT 'runs' AS tbl, container_id, count(*) AS n FROM runs WHERE container_id % 5 <> 2 GROUP BY container_id
UNION ALL SELECT 'channel_metrics', container_id, count(*) FROM chm WHERE container_id % 5 <> 2 GROUP BY container_id
UNION ALL SELECT 'container_metrics', container_id, 1 FROM cm WHERE container_id % 5 <> 2"""
    ),
)
def _(d):
    tables = {"runs": d.runs, "channel_metrics": d.channel_metrics, "container_metrics": d.container_metrics}
    out = None
    for name, df in T.roll_back(tables, ledger_of(d), "run_2").items():
        part = df.groupBy("container_id").agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("s14_compact", sql(f"SELECT {SAMPLE} FROM bronze"))
def _(d):
    table = T.VersionedTable(d.spark, scratch_folder(d.spark, "compact"))
    table.write(d.samples.select(*COLUMNS).repartition(16))
    table.compact(["container_id", "channel_id", "time"])
    return table.read()


@query(
    "s15_report_tables",
    sql("SELECT 'channel_metrics' AS tbl, count(*) AS cnt, false AS still_there FROM chm UNION ALL SELECT 'runs', count(*), false FROM runs"),
)
def _(d):
    from seriesloom.plans.rollups import row_counts

    views = {"runs": d.runs, "channel_metrics": d.channel_metrics}
    for name, df in views.items():
        df.createOrReplaceTempView(f"drive_{name}")
    found = {n: views[n] for n in T.report_tables(d.spark, "drive")}
    T.drop_report_tables(d.spark, "drive")
    left = T.report_tables(d.spark, "drive")
    return row_counts(found).withColumn("still_there", F.col("tbl").isin(left) if left else F.lit(False))


@query(
    "s16_conditional_update",
    """SELECT p_name AS name, CASE WHEN min(p_size) % 2 = 0 THEN min(p_size) + 1 ELSE min(p_size) END AS size, min(p_type) AS kind FROM part GROUP BY p_name""",
)
def _(d):
    target = d.table("part").groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_size").alias("size"), F.min("p_type").alias("kind")
    )
    source = target.where(F.col("size") % 2 == 0).withColumn("size", F.col("size") + 1)
    extra = source.withColumn("name", F.concat(F.lit("unknown "), "name"))
    return T.update_if_changed(target, source.unionByName(extra), "name", ["size", "kind"])


@query(
    "s17_union_tables",
    sql(
        """SELECT container_id, channel_id, time, value, 'veh_' || channel_id AS vehicle_key FROM bronze WHERE channel_id <> 2"""
    ),
)
def _(d):
    rows = d.samples.select(*COLUMNS)
    parts = [rows.where(F.col("channel_id") == i) for i in range(1, 6)]
    union = T.union_tables(parts, [f"veh_{i}" for i in range(1, 6)])
    return union.where(F.col("vehicle_key") != "veh_2")


@query(
    "s17_data_locations",
    sql("SELECT DISTINCT vehicle_key, 'table_' || channel_name AS location FROM bronze WHERE vehicle_key IN ('veh_0', 'veh_3')"),
)
def _(d):
    mapping = d.samples.select("vehicle_key", F.concat(F.lit("table_"), "channel_name").alias("location"))
    return T.data_locations(mapping, ["veh_0", "veh_3"])


@query("s18_snapshot", sql("SELECT channel_alias_name, channel_name, unit, description FROM aliases"))
def _(d):
    return T.snapshot(d.aliases, scratch_folder(d.spark, "aliases"))


@query(
    "s20_check_source",
    """SELECT epoch_us(ts) * 1000 AS tstart, value, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = 'events') AS columns
FROM events LIMIT 1""",
)
def _(d):
    """First row of the sample table by a candidate expression, with the columns of the table beside it."""
    first = T.check_source(d.table("events"), "unix_micros(cast(ts as timestamp)) * 1000", "value")
    return first.select("tstart", "value").withColumn("columns", F.lit(",".join(d.table("events").columns)))

from __future__ import annotations

import math
import shutil
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.tags import comment_tags, dir_name, filename_tags, signal_name, signal_unit
from seriesloom.functions.times import parse_timestamp
from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.viewer import _outer, downsample, evenly_spaced, largest_triangles, normalise, window_points
from seriesloom.plans.catalog import MeasurementCatalog
from seriesloom.plans.profile import AliasMap, Profile
from seriesloom.sources import tables as T
from seriesloom.sources.ledger import LEDGER, choose_run, mark_run, next_run
from seriesloom.sources.recordings import assign_bins, attach_containers, list_channels, number_channels, read_bins, replicate, split_channels
from seriesloom.sources.scratch import scratch_folder
from seriesloom.streaming.discover import discover



def ledger(spark, *rows):
    data = [(i, run, f"f{i}", status, datetime(2024, 1, day), None) for i, (run, status, day) in enumerate(rows)]
    return spark.createDataFrame(data, LEDGER)


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("a", "in_progress", 1), ("b", "in_progress", 2)], ("error", "noop")),
        ([("a", "in_progress", 1), ("b", "failed", 2)], ("redo_active", "a")),
        ([("a", "failed", 1), ("b", "failed", 2), ("c", "unprocessed", 1)], ("redo_failed", "b")),
        ([("a", "unprocessed", 2), ("b", "unprocessed", 1), ("c", "succeeded", 1)], ("process", "b")),
        ([("c", "succeeded", 1)], ("noop", "noop")),
    ],
)
def test_next_run(spark, rows, want):
    assert tuple(next_run(ledger(spark, *rows)).first()) == want


def test_next_run_switches(spark):
    active = ledger(spark, ("a", "in_progress", 1))
    with pytest.raises(RuntimeError):
        choose_run(active, redo_active=False)
    failed = ledger(spark, ("a", "failed", 1), ("b", "unprocessed", 1))
    assert tuple(next_run(failed, redo_failed=False).first()) == ("skip_failed", "noop")
    assert next_run(spark.createDataFrame([], LEDGER)).first()["run_id"] == "noop"


def test_mark_run(spark):
    done = mark_run(ledger(spark, ("a", "in_progress", 1), ("b", "unprocessed", 2)), "a", "succeeded")
    rows = {r["run_id"]: r for r in done.collect()}
    assert rows["a"]["status"] == "succeeded" and rows["a"]["_processing_done_ts"] is not None
    assert rows["b"]["status"] == "unprocessed" and rows["b"]["_processing_done_ts"] is None


def test_versioned_table(spark, tmp_path):
    table = T.VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    assert table.create(spark.createDataFrame([], "k int, v string").schema)
    assert not table.create(spark.createDataFrame([], "k int, v string").schema)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    table.upsert(spark.createDataFrame([(2, None), (3, "d")], "k int, v string"), ["k"], ["v"])
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, None), (3, "d")]
    table.compact(["k"])
    assert table.read().count() == 3
    # a version without its success marker is not there
    (tmp_path / "t" / "version=99").mkdir()
    assert table.read().count() == 3


def test_scratch_follows_the_cluster():
    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.master": master} | ({"spark.checkpoint.dir": folder} if folder else {})

    assert scratch_folder(Session("yarn", "/shared/folder/"), "x").startswith("/shared/folder/x-")
    assert "/seriesloom-" in scratch_folder(Session("local[4]"), "x")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch_folder(Session(master), "x")


def test_discover_sees_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), str(tmp_path / "ledger"), str(tmp_path / "check"))
    for i in range(5):
        (src / f"r{i}.dat").write_text("x")
    discover(*args, max_files=2)
    first = spark.read.parquet(str(tmp_path / "ledger"))
    assert first.count() == 5 and first.select("run_id").distinct().count() == 3
    shutil.copy(src / "r0.dat", src / "r9.dat")
    discover(*args, max_files=2)
    again = spark.read.parquet(str(tmp_path / "ledger"))
    assert again.count() == 6 and again.select("container_id").distinct().count() == 6
    assert again.where(F.col("filename").startswith("/")).count() == 6


def test_discovery_survives_a_crash(spark, tmp_path):
    """A micro-batch that is repeated after its rows were entered, and one that died before, lose and double nothing."""
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        (src / f"r{i}.dat").write_text("x")
    table = T.VersionedTable(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([], "filename string, run_id string").schema)
    fail = {"before": True, "after": True}

    def enter(rows, number):
        rows = rows.select("filename", "run_id")
        if fail["before"]:
            fail["before"] = False
            raise OSError("before the ledger")
        known = table.read()
        table.write(known.unionByName(rows.join(known, "filename", "left_anti")))
        if fail["after"]:
            fail["after"] = False
            raise OSError("after the ledger")

    args = (spark, str(src), enter, str(tmp_path / "check"))
    for _ in range(2):
        with pytest.raises(Exception, match="the ledger"):
            discover(*args, max_files=3)
    discover(*args, max_files=3)
    rows = table.read().collect()
    assert len(rows) == len({r["filename"] for r in rows}) == 4 and len({r["run_id"] for r in rows}) == 2


def test_recordings_end_to_end(spark, tmp_path):
    for f in range(3):
        np.savez(tmp_path / f"r{f}.npz", speed=np.arange(10.0) + f, temp=np.arange(25.0) * f, lone=np.array([1.0]))
    files = spark.createDataFrame([(str(tmp_path / f"r{f}.npz"),) for f in range(3)], "filename string")

    def channels(path):
        with np.load(path) as data:
            for i, name in enumerate(sorted(data.files)):
                yield {"group_idx": 0, "channel_idx": i, "channel_name": name, "unit": "u", "sample_count": len(data[name])}

    def decode(path, group, channel, first, n):
        with np.load(path) as data:
            v = data[sorted(data.files)[channel]][first : first + n]
        return pd.DataFrame({"time": np.arange(first, first + len(v)), "value": v})

    found = number_channels(list_channels(files, channels))
    assert found.count() == 9 and found.agg(F.max("channel_id")).first()[0] == 3
    found = found.withColumn("container_id", F.xxhash64("filename"))
    tasks = assign_bins(split_channels(found, 8), 20, F.lit(0))
    load = tasks.groupBy("shard", "bin").agg(F.sum("n_samples").alias("n"))
    assert load.agg(F.max("n")).first()[0] <= 28 and load.agg(F.sum("n")).first()[0] == 108
    rows = read_bins(tasks, decode)
    assert rows.count() == 108
    assert rows.where("brand = 'NA' AND group_idx = 0 AND channel_idx = channel_id - 1").count() == 108
    per = rows.groupBy("filename", "channel_name").agg(F.countDistinct("time").alias("n"), F.sum("value").alias("s"))
    assert {(r["filename"][-6:-4], r["channel_name"]): (r["n"], r["s"]) for r in per.collect()}[("r2", "temp")] == (25, 600.0)


def test_recording_pieces(spark, tmp_path):
    """Tags, invalid samples, channels that are no numbers, pieces beyond a block; only asked channels are read."""
    from seriesloom.sources import recording_source

    long = recording_source.BLOCK + 5
    opened = tmp_path / "opened"
    opened.mkdir()

    def channels(path):
        comment = "{'brand': 'vw', 'vehicle_key': 'v1'}"
        yield {"group_idx": 2, "channel_idx": 0, "channel_name": "speed", "unit": "km/h", "sample_count": 4, "comment": comment}
        yield {"group_idx": 2, "channel_idx": 1, "channel_name": "name", "unit": "", "sample_count": 3}
        yield {"group_idx": 3, "channel_idx": 0, "channel_name": "long", "unit": "", "sample_count": long}

    def decode(path, group, channel, first, n):
        (opened / f"{group}-{channel}-{first}").touch()
        if (group, channel) == (2, 1):
            return pd.DataFrame({"time": [1, 2, 3], "value": ["a", "b", "c"]})
        if group == 3:
            at = np.arange(first, first + n)
            return pd.DataFrame({"time": at, "value": at % 7})
        frame = pd.DataFrame({"time": [1, 2, 3, 4], "value": [1, 2, 3, 4], "invalid": [False, True, False, False]})
        return frame.iloc[first : first + n]

    files = spark.createDataFrame([(7, "/nowhere/a")], "container_id bigint, filename string")
    found = attach_containers(number_channels(list_channels(files, channels)), files)
    tasks = assign_bins(split_channels(found, 3), 5, F.lit(0)).where("channel_name != 'long'")
    whole = assign_bins(split_channels(found, 10**6), 10**6, F.lit(0)).where("channel_name = 'long'")
    rows = read_bins(tasks.unionByName(whole), decode)
    speed = sorted((r["time"], r["value"], r["brand"], r["vehicle_key"], r["model"]) for r in rows.where("group_idx = 2").collect())
    assert [r[0] for r in speed] == [1, 2, 3, 4] and [r[1] for r in speed if r[0] != 2] == [1.0, 3.0, 4.0] and math.isnan(speed[1][1])
    assert {r[2:] for r in speed} == {("vw", "v1", "NA")}
    assert rows.where("group_idx = 3").agg(F.count("*"), F.sum("value"), F.max("time")).first()[:] == (
        long, float(sum(i % 7 for i in range(long))), long - 1,
    )
    for f in opened.iterdir():
        f.unlink()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        asked = read_bins(tasks.unionByName(whole), decode).where("channel_name = 'speed'")
        assert asked.count() == 4 and sorted(f.name for f in opened.iterdir()) == ["2-0-0", "2-0-3"]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_the_recording_file_is_read_by_place(tmp_path):
    from workload.recording_file import RecordingDecoder, recording_channels, write_recording

    path = str(tmp_path / "a.rec")
    a = {"name": "a", "unit": "u", "comment": "{}", "time": [1, 2, 3], "value": [5.0, 6.0, 7.0]}
    write_recording(path, [a, {**a, "name": "b", "time": [4, 5], "value": [1.5, 2.5], "invalid": [0, 1]}])
    assert [(c["channel_name"], c["sample_count"]) for c in recording_channels(path)] == [("a", 3), ("b", 2)]
    read = RecordingDecoder()
    assert read(path, 0, 0, 1, 9).to_dict("list") == {"time": [2, 3], "value": [6.0, 7.0]}
    assert read(path, 0, 1, 0, 2).to_dict("list") == {"time": [4, 5], "value": [1.5, 2.5], "invalid": [False, True]}


@pytest.mark.parametrize("times,want", [(0, [0, 10, 20]), (1, [0, 10, 20, 20, 30, 40])])
def test_replicate(spark, grid, times, want):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 10, 2.0), (1, 20, 3.0)], "container_id int, time bigint, value double")
    out = replicate(df, times, grid)
    assert sorted(r["time"] for r in out.collect()) == want
    assert out.count() == 3 * (times + 1)


def test_texts(spark):
    df = spark.createDataFrame(
        [("<TX>{'brand': 'vw', 'model': 'x'}</TX>", "/a/b/c.csv", "Oil temp [°C]"), (None, "c.csv", "Plain")],
        "c string, p string, h string",
    )
    rows = df.select(comment_tags(F.col("c"), ("brand", "city")), dir_name(F.col("p")), signal_name(F.col("h")), signal_unit(F.col("h"))).collect()
    assert [tuple(r[0]) for r in rows] == [("vw", "NA"), ("NA", "NA")]
    assert [tuple(r)[1:] for r in rows] == [("/a/b", "Oil temp", "C"), ("", "Plain", "")]
    name = spark.createDataFrame([("2017-07-05_Seat_Leon_RT_S_Stau.csv",)], "n string")
    assert tuple(name.select(filename_tags(F.col("n"))).first()[0]) == ("2017-07-05", "Seat", "Leon", "RT", "S", "Stau")
    stamps = spark.createDataFrame([("2025-10-01T00:00",), ("2025-10-01 10:20:30",), ("x",)], "t string")
    parsed = [r[0] for r in stamps.select(F.date_format(parse_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert parsed == ["2025-10-01 00:00:00", "2025-10-01 10:20:30", None]


def test_alias_search_takes_any_keyword(spark):
    aliases = spark.createDataFrame([("o'temp", "a%b", "C", "d"), ("speed", "c", "km/h", "d")], "channel_alias_name string, channel_name string, unit string, description string")
    catalog = MeasurementCatalog({"aliases": aliases}, Profile(aliases=AliasMap(table="aliases")))
    assert [r["channel_name"] for r in catalog.alias_search("o't").collect()] == ["a%b"]
    assert [r["channel_name"] for r in catalog.alias_search("%").collect()] == ["a%b"]
    with pytest.raises(ValueError):
        MeasurementCatalog({"aliases": aliases}, Profile()).alias_search("x")


# -- viewer ----------------------------------------------------------------------------------------------------------
def wave(spark, n):
    return spark.range(n).select(
        F.lit(1).alias("container_id"), F.lit(1).alias("channel_id"), F.col("id").alias("t"), F.sin(F.col("id") / 50).alias("value")
    )


@pytest.mark.parametrize("n,n_out,want", [(3, 10, 3), (1000, 100, 100), (1000, 50, 50)])
def test_downsample_size_and_ends(spark, grid, n, n_out, want):
    rows = sorted((r["t"], r["value"]) for r in downsample(wave(spark, n), n_out, grid).collect())
    assert len(rows) == want and rows[0][0] == 0 and rows[-1][0] == n - 1
    assert all(math.isclose(v, math.sin(t / 50)) for t, v in rows)


@pytest.mark.parametrize("n", [3, 20, 21, 160, 161, 1000])
def test_downsample_is_the_plain_method_at_every_size(spark, grid, n):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)  # parts of buckets
    rng = np.random.default_rng(n)
    t = np.sort(rng.integers(0, 10 * n, n))
    v = np.where(rng.random(n) < 0.02, np.nan, rng.normal(size=n).cumsum())
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    df = spark.createDataFrame([(1, 2, int(a), float(b)) for a, b in zip(t, v)], "container_id bigint, channel_id int, t bigint, value double")
    got = sorted((r["t"], repr(r["value"])) for r in downsample(df, 20, grid).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    picks = largest_triangles((t - t[0]).astype(float), v, 20)
    assert got == sorted((int(t[i]), repr(float(v[i]))) for i in picks)


def test_downsample_keeps_a_spike(spark):
    df = wave(spark, 20_000).withColumn("value", F.when(F.col("t") == 7777, 50.0).otherwise(F.col("value")))
    rows = downsample(df, 60, TimeGrid(1000)).collect()
    assert len(rows) == 60 and 7777 in {r["t"] for r in rows}


def brute_corners(points):
    """Points that are the only farthest one in some direction, by trying many directions."""
    out = set()
    for angle in np.linspace(0, 2 * np.pi, 3001):
        far = [round(x * math.cos(angle) + y * math.sin(angle), 9) for x, y in points]
        best = max(far)
        if far.count(best) == 1:
            out.add(far.index(best))
    return out


@pytest.mark.parametrize("shape", ["noise", "steps", "bow", "line", "one time"])
def test_no_corner_is_lost(shape):
    rng = np.random.default_rng(len(shape))
    t = np.sort(rng.integers(0, 60, 80)).astype(float)
    v = {
        "noise": rng.normal(size=80),
        "steps": rng.integers(0, 3, 80).astype(float),
        "bow": -((t - 30) ** 2),
        "line": 2 * t,
        "one time": rng.normal(size=80),
    }[shape]
    if shape == "one time":
        t[:] = 5
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    points = list(dict.fromkeys(zip(t, v)))
    both = np.r_[t, t], np.r_[v, v], np.repeat([0, 1], 80)  # two groups at once
    kept = {int(i) for side in (1, -1) for i in _outer(both[2], both[0], both[1], side)}
    for shift in (0, 80):
        there = {(t[i - shift], v[i - shift]) for i in kept if shift <= i < shift + 80}
        assert {points[i] for i in brute_corners(points)} <= there
    if shape in ("noise", "line"):
        assert len(kept) < 60


def test_downsample_of_values_without_triangles(spark, grid):
    nan, inf = float("nan"), float("inf")
    values = [1.0, nan, None, inf, 5.0, None, nan, nan, 2.0, -inf, 3.0, None] * 4
    df = spark.createDataFrame([(1, 2, 3 * i, v) for i, v in enumerate(values)], "container_id bigint, channel_id int, t bigint, value double")
    got = {r["t"]: r["value"] for r in downsample(df, 9, grid).collect()}
    v = np.array([nan if x is None else x for x in values])
    assert sorted(got) == [3 * int(i) for i in largest_triangles(3.0 * np.arange(len(v)), v, 9)]
    assert all((got[t] is None) == (values[t // 3] is None) for t in got)


def test_triangles_are_chosen_in_order():
    t = np.arange(500, dtype=float)
    picks = largest_triangles(t, np.sin(t / 9), 40)
    assert len(set(picks)) == 40 and (np.diff(picks) > 0).all()


@pytest.mark.parametrize("n,n_out", [(10, 4), (1000, 7), (5, 5), (4, 9)])
def test_evenly_spaced_is_linspace(spark, grid, n, n_out):
    got = sorted(r["t"] for r in evenly_spaced(wave(spark, n), n_out, grid).collect())
    want = list(range(n)) if n <= n_out else np.round(np.linspace(0, n - 1, n_out)).astype(int).tolist()
    assert got == want


def test_window_and_normalise(spark, grid):
    df = spark.createDataFrame([(1, 1, t * 1000, v) for t, v in enumerate([10.0, 20.0, 30.0])], "container_id int, channel_id int, t bigint, value double")
    assert window_points(df, 1000, 2000).count() == 2
    rows = sorted(tuple(r)[2:] for r in normalise(df, grid).collect())
    assert rows == [(0.0, 0.0, 10.0), (1.0, 0.5, 20.0), (2.0, 1.0, 30.0)]
    flat = normalise(df.withColumn("value", F.lit(5.0)), grid)
    assert {r["v"] for r in flat.collect()} == {0.0}

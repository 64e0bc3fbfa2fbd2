"""The ingest job: every file once, failed runs leave nothing behind."""

from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.plans import ingest
from seriesloom.plans.ingest import TABLES, IngestJob
from seriesloom.sources.recording_source import CONSTANT, RecordingReader, TaskFile


def decoders():
    """Functions that are sent to the workers by value."""

    def names(path):
        yield {"group_idx": 0, "channel_idx": 0, "channel_name": "a", "unit": "u", "sample_count": 4}

    def read(path, group, channel, first, n):
        rows = pd.read_csv(path.removeprefix("file:"), names=["time", "value"])
        return rows.iloc[first : first + n]

    def broken(path, group, channel, first, n):
        raise OSError("unreadable")

    return names, read, broken


def test_runs_are_processed_once_and_rolled_back(spark, tmp_path):
    names, read, broken = decoders()
    files = tmp_path / "files"
    files.mkdir()
    for i in range(2):
        (files / f"{i}.csv").write_text("0,1\n1,1\n2,5\n3,5\n")
    job = IngestJob(spark, str(tmp_path / "job"), names, read, 1000, max_samples=3, pattern="*.csv")
    assert len(job.run(str(files))) == 1 and job.run(str(files)) == []
    assert not job.grid().sliced
    keys = {r["key"] for r in job.table("channel_tags").collect()}, {r["key"] for r in job.table("container_tags").collect()}
    assert {"channel_name", "unit", "brand", "group_idx"} <= keys[0] and {"file_uri", "filename", "vehicle_key"} <= keys[1]
    assert sorted((r["tstart"], r["tend"], r["value"]) for r in job.table("silver").collect()) == [(0, 2, 1.0), (0, 2, 1.0), (2, 3, 5.0), (2, 3, 5.0)]

    (files / "2.csv").write_text("0,1\n1,1\n2,5\n3,5\n")
    bad = IngestJob(spark, job.root, names, broken, 1000, pattern="*.csv")
    with pytest.raises(Exception, match="unreadable"):
        bad.run(str(files))
    assert job.table("silver").count() == 4
    assert {r["status"] for r in job.ledger.read().collect()} == {"succeeded", "failed"}
    assert len(job.run(str(files))) == 1
    assert job.table("silver").count() == 6 and job.table("bronze").count() == 12


def small_files(folder, n):
    folder.mkdir()
    for i in range(n):
        path = folder / f"{i:02d}.csv"
        path.write_text(f"0,{i}\n1,{i}\n2,5\n3,5\n")
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)


def test_small_runs_are_processed_together(spark, tmp_path, monkeypatch):
    """Twenty runs take three passes, and every run has its own partition of every table."""
    names, read, _ = decoders()
    small_files(tmp_path / "files", 20)
    passes, one = [], IngestJob._process
    monkeypatch.setattr(IngestJob, "_process", lambda self, runs: passes.append(runs) or one(self, runs))
    job = IngestJob(spark, str(tmp_path / "job"), names, read, 1000, max_files=1, max_samples=3, pattern="*.csv")
    done = job.run(str(tmp_path / "files"))
    assert len(done) == len(set(done)) == 20 and job.next() == "noop"
    assert [len(p) for p in passes] == [1, 16, 3]
    ledger = {r["run_id"]: r for r in job.ledger.read().collect()}
    assert [ledger[r]["filename"][-6:] for r in done] == [f"{i:02d}.csv" for i in range(20)]  # the oldest file first
    assert {r["status"] for r in ledger.values()} == {"succeeded"} and all(r["_processing_done_ts"] for r in ledger.values())
    for name in TABLES:
        assert {f"run_id={r}" for r in done} <= set(os.listdir(f"{job.root}/{name}"))
        if name != "slices":
            wrong = job.table(name).join(job.ledger.read().select("container_id", F.col("run_id").alias("own")), "container_id")
            assert wrong.where("own != run_id").isEmpty() and job.table(name).select("run_id").distinct().count() == 20
    assert not job.grid().sliced and job.table("bronze").count() == 80
    runs = sorted((r["tstart"], r["tend"], r["value"]) for r in job.table("silver").collect())
    assert runs == sorted([(0, 2, float(i)) for i in range(20) if i != 5] + [(2, 3, 5.0)] * 19 + [(0, 3, 5.0)])


def test_large_runs_stay_by_themselves(spark, tmp_path, monkeypatch):
    names, read, _ = decoders()
    small_files(tmp_path / "files", 4)
    monkeypatch.setattr(ingest, "GROUP_SAMPLES", 7)
    passes, one = [], IngestJob._process
    monkeypatch.setattr(IngestJob, "_process", lambda self, runs: passes.append(runs) or one(self, runs))
    job = IngestJob(spark, str(tmp_path / "job"), names, read, 1000, max_files=1, pattern="*.csv")
    assert len(job.run(str(tmp_path / "files"))) == 4 and [len(p) for p in passes] == [1] * 4


def test_a_failing_run_of_a_group_fails_by_itself(spark, tmp_path):
    names, read, _ = decoders()
    small_files(tmp_path / "files", 6)

    def broken(path, *place):
        if path.endswith("03.csv"):
            raise OSError("unreadable")
        return read(path, *place)

    bad = IngestJob(spark, str(tmp_path / "job"), names, broken, 1000, max_files=1, pattern="*.csv")
    with pytest.raises(Exception, match="unreadable"):
        bad.run(str(tmp_path / "files"))
    status = {r["filename"][-6:]: r["status"] for r in bad.ledger.read().collect()}
    assert status == dict(zip([f"{i:02d}.csv" for i in range(6)], ["succeeded"] * 3 + ["failed"] + ["unprocessed"] * 2, strict=True))
    assert bad.table("silver").select("container_id").distinct().count() == 3
    assert len(os.listdir(f"{bad.root}/bronze")) - os.listdir(f"{bad.root}/bronze").count("_SUCCESS") - os.listdir(f"{bad.root}/bronze").count("._SUCCESS.crc") == 3
    job = IngestJob(spark, bad.root, names, read, 1000, max_files=1, pattern="*.csv")
    assert len(job.run(str(tmp_path / "files"))) == 3 and job.table("bronze").count() == 24


def test_small_pieces_are_sent_together(tmp_path):
    def decode(path, group, channel, first, n):
        return pd.DataFrame({"time": range(first, first + n), "value": [float(channel)] * n})

    rows = [{**{c: "x" for c in CONSTANT}, "container_id": 1, "channel_id": i + 1, "group_idx": 0, "channel_idx": i} for i in range(50)]
    pd.DataFrame([{**r, "first_sample": 0, "n_samples": 3 if r["channel_idx"] else 40_000} for r in rows]).to_parquet(tmp_path / "t.parquet")
    batches = list(RecordingReader(decode, []).read(TaskFile(str(tmp_path / "t.parquet"))))
    assert len(batches) == 3 and max(len(t) for b in batches for t in b.column("times").to_pylist()) == 1 << 14
    got = [(c, t, v) for b in batches for c, ts, vs in zip(*(b.column(n).to_pylist() for n in ("channel_id", "times", "values")), strict=True) for t, v in zip(ts, vs, strict=True)]
    assert got == [(i + 1, t, float(i)) for i in range(50) for t in range(3 if i else 40_000)]

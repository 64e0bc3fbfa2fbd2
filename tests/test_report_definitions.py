from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.runs import encode_runs
from seriesloom.operators.series import SampleSeries
from seriesloom.plans import rollups as R
from seriesloom.plans.charts import assign_axes, default_x_channel
from seriesloom.plans.compare import verdict
from seriesloom.plans.definitions import Event, Histogram1D, Histogram2D, ReportDefinition, Signal, Statistics, Threshold
from seriesloom.plans.dictionary import match_families
from seriesloom.plans.profile import AliasMap, ChannelMap, Profile, SeriesMap, TagMap, VehicleRule
from seriesloom.plans.report import Report, evaluate_event, session_batches
from seriesloom.plans.report_run import ReportRun
from seriesloom.sources.tables import BucketedTable

RPM = Signal("rpm", channel={"channel_name": "nmot"})
BINS = [0, 1000, 2000, 3000, 7000]


def test_bad_events():
    for kwargs in (
        {"kind": "interval"},
        {"kind": "nothing"},
        {"kind": "periodic_distance", "signal": "odo"},
        {"kind": "periodic_distance", "signal": "odo", "step": -1},
        {"kind": "periodic_distance", "step": 5},
        {"kind": "change_points", "signal": "gear", "from_state": 1},
        {"kind": "interval", "conditions": [Threshold("a", ">", 1)], "logic": "XOR"},
    ):
        with pytest.raises(ValueError):
            Event("e", **kwargs)
    with pytest.raises(ValueError):
        Threshold("a", "~", 1)


def test_event_result_types():
    assert Event("e", "periodic_distance", signal="odo", step=5).result_type == "Intervals"
    assert Event("e", "rising_edges", [Threshold("a", ">", 1)]).result_type == "PointsInTime"


def test_bad_aggregations():
    with pytest.raises(ValueError):
        Histogram1D("h", "rpm", BINS, kind="distance")
    with pytest.raises(ValueError):
        Histogram1D("h", "rpm", [1])
    with pytest.raises(ValueError):
        Statistics("s", ["rpm"], ["mode"])
    with pytest.raises(ValueError):
        Signal("not a name", channel={})


def test_references_are_checked():
    rise = Event("rise", "rising_edges", [Threshold("rpm", ">", 4000)])
    ReportDefinition("r", [RPM], [rise], [Statistics("s", ["rpm"], event="rise")])
    for aggregation in (
        Histogram1D("h", "gone", BINS),
        Histogram1D("h", "rpm", BINS, event="gone"),
        Histogram1D("h", "rpm", BINS, event="rise"),
        Histogram2D("h", "rpm", "rpm", BINS, BINS, event="rise"),
    ):
        with pytest.raises(ValueError):
            ReportDefinition("r", [RPM], [rise], [aggregation])


def runs(spark, grid, rows):
    return SampleSeries(spark.createDataFrame([(1, *r) for r in rows], "container_id bigint, tstart bigint, tend bigint, value double"), grid)


def test_events_evaluate(spark, grid):
    signals = {
        "rpm": runs(spark, grid, [(0, 10, 5000.0), (10, 20, 100.0), (20, 30, 4500.0)]),
        "temp": runs(spark, grid, [(0, 5, 95.0), (5, 30, 80.0)]),
        "gear": runs(spark, grid, [(0, 8, 1.0), (8, 20, 2.0), (20, 25, 1.0), (25, 30, 2.0)]),
        "odo": runs(spark, grid, [(0, 4, 900.0), (4, 8, 1100.0), (8, 12, 1900.0), (12, 16, 2050.0), (16, 20, 3500.0)]),
    }
    hot = [Threshold("rpm", ">", 4000), Threshold("temp", "<", 90)]

    def rows(event):
        return sorted(tuple(r)[1:] for r in evaluate_event(event, signals).frame.collect())

    assert rows(Event("e", "interval", hot)) == [(5, 10), (20, 30)]
    assert rows(Event("e", "interval", hot, logic="OR")) == [(0, 30)]
    assert rows(Event("e", "rising_edges", hot)) == [(5,), (20,)]
    assert rows(Event("e", "falling_edges", hot)) == [(10,), (30,)]
    assert rows(Event("e", "change_points", signal="gear", from_state=1, to_state=2)) == [(8,), (25,)]
    assert rows(Event("e", "periodic_distance", signal="odo", step=1000)) == [(4, 12)]


def test_report_tables_on_both_grids(spark, grid, tmp_path):
    rpm = runs(spark, grid, [(0, 10, 5000.0), (10, 20, 100.0), (20, 30, 1500.0)])
    definition = ReportDefinition(
        "r",
        [RPM, Signal("double", build=lambda s: s["rpm"] * 2)],
        [Event("high", "interval", [Threshold("rpm", ">", 1000)])],
        [
            Histogram1D("h", "rpm", BINS),
            Histogram1D("masked", "double", BINS, event="high"),
            Statistics("s", ["rpm"], ["max", "count"], event="high"),
        ],
    )
    report = Report(spark, definition, lambda tags: rpm, scratch=str(tmp_path / "scratch"))
    paths = report.write(str(tmp_path / "gold"), batch=1)
    tables = {n: spark.read.parquet(p) for n, p in paths.items()}
    fact = tables["histogram_fact"].orderBy("visual_id", "bin_id").collect()
    assert [(r["visual_id"], r["hist_value"]) for r in fact] == [
        (1, 10.0), (1, 10.0), (1, 0.0), (1, 10.0), (2, 0.0), (2, 0.0), (2, 0.0), (2, 10.0),
    ]
    assert {r["name"]: r["status"] for r in R.validate_histograms(tables["histogram_fact"], tables["histogram_dimension"]).collect()} == {
        "h": "OK",
        "masked": "OK",
    }
    levels = R.validate_report(tables)
    assert [lv["passed"] for lv in levels] == [True, True, True]
    assert [lv["passed"] for lv in R.validate_report({"histogram_fact": tables["histogram_fact"]})] == [False]
    stats = {r["aggregation_label"]: r["statistic_value"] for r in tables["stats_aggregator_fact"].where("statistic_value > 1").collect()}
    assert stats["max"] in (5000.0, 1500.0)
    assert tables["interval_event_fact"].count() == 2
    shares = R.rollup_1d(tables["histogram_fact"], tables["histogram_dimension"], 1000, ["h"]).orderBy("bin_id")
    assert [round(r["relative_pct"], 3) for r in shares.collect()] == [33.333, 33.333, 0.0, 33.333]


def many(n, weights=False):
    """``n`` histograms over two signals, a formula of both, and one event."""
    out = []
    for i in range(n):
        signal = ("rpm", "load", "both")[i % 3]
        edges = [float(e) for e in range(0, 40 + i % 7, 5 + i % 3)]
        out.append(Histogram1D(f"h{i}", signal, edges, event="high" if i % 2 else None, max_duration=3 if i % 5 == 0 else None))
    return out


def report_with(spark, grid, aggregations):
    load = Signal("load", channel={"channel_name": "load"})
    definition = ReportDefinition(
        "r",
        [RPM, load, Signal("both", build=lambda s: (s["rpm"] + s["load"]) / 2), Signal("sure", build=lambda s: s["both"] * 0 + s["rpm"])],
        [Event("high", "interval", [Threshold("rpm", ">", 10)]), Event("up", "rising_edges", [Threshold("rpm", ">", 10)])],
        aggregations,
    )
    series = {
        "nmot": runs(spark, grid, [(0, 10, 5.0), (10, 25, 20.0), (25, 30, 11.0), (30, 44, 0.0), (44, 50, 35.0), (50, 50, 1.0)]),
        "load": runs(spark, grid, [(2, 12, 30.0), (12, 40, 10.0), (41, 48, 12.0)]),
    }
    return Report(spark, definition, lambda tags: series[tags["channel_name"]]), series


def test_definitions_are_data(spark, grid, tmp_path):
    """The one plan for all definitions gives what each definition alone gives, formulas included."""
    from seriesloom.operators import histograms as H
    from seriesloom.operators.statistics import event_statistics

    joint = Histogram2D("xy", "rpm", "both", [0, 10, 40], [0.0, 5.0, 15.0, 50.0], event="high")
    lone = Histogram2D("xx", "rpm", "rpm", [0, 10, 40], [0.0, 5.0, 15.0, 50.0])
    extra = [
        Histogram1D("n", None, [0, 5, 50], kind="duration_count", event="high", weight_const=2.5),
        Histogram1D("at", "both", [0, 15, 50], kind="event_count", event="up"),
        Histogram1D("far", "load", [0, 11, 50], kind="distance", weight_signal="rpm", event="high"),
        Statistics("s", ["rpm", "both"], ["max", "median", "count"], event="high"),
        Statistics("t", ["load"], ["mean", "std"]),
    ]
    report, series = report_with(spark, grid, [*many(20), joint, lone, *extra])
    report._scratch = str(tmp_path / "scratch")
    rpm, load = series["nmot"], series["load"]
    both = (rpm + load) / 2
    high, up = rpm > 10, (rpm > 10).rising_edges()
    plain = {"rpm": rpm, "load": load, "both": both}

    def rows(df, *drop):
        found = df.drop("visual_id", "event_instance_id", *drop).collect()
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found)

    facts = next(report.facts(Histogram1D)).persist()
    assert facts.select("visual_id").distinct().count() == 23
    for i in (1, 2, 3, 6):
        h = many(20)[i - 1]
        want = H.duration_histogram(plain[h.signal], h.bins, high if h.event else None, h.max_duration)
        assert rows(facts.where(F.col("visual_id") == i)) == rows(want), h
    wants = [
        H.duration_count_histogram(high, [0, 5, 50], 2.5),
        H.event_count_histogram(both, up, [0, 15, 50]),
        H.distance_histogram(load, rpm, [0, 11, 50], high),
    ]
    for i, want in enumerate(wants, 23):
        assert rows(facts.where(F.col("visual_id") == i)) == rows(want)
    two = next(report.facts(Histogram2D))
    assert rows(two.where("visual_id = 21")) == rows(H.joint_histogram([rpm, both], [joint.x_bins, joint.y_bins], high))
    assert rows(two.where("visual_id = 22")) == rows(H.joint_histogram([rpm, rpm], [lone.x_bins, lone.y_bins]))
    stats = next(report.facts(Statistics))
    assert rows(stats.where("visual_id = 26")) == rows(event_statistics({"rpm": rpm, "both": both}, high, ["max", "median", "count"]))
    assert rows(stats.where("visual_id = 27")) == rows(event_statistics({"load": load}, None, ["mean", "std"]))
    assert sorted(tuple(r) for r in report.signal("sure").frame.collect()) == sorted(tuple(r) for r in (both * 0 + rpm).frame.collect())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_plans_do_not_grow_with_definitions(spark):
    few, _ = report_with(spark, TimeGrid(1000), many(12))
    lots, _ = report_with(spark, TimeGrid(1000), many(1000))
    at = time.time()
    plan = next(lots.facts(Histogram1D))
    assert exchanges(plan) == exchanges(next(few.facts(Histogram1D)))
    assert plan.select("visual_id").distinct().count() == 1000
    assert time.time() - at < 60


def test_runs_over_batches_equal_one_run(spark, tmp_path):
    """Recordings come, change and come again; a batch that died half way is written over."""
    kind = "container_id bigint, tstart bigint, tend bigint, value double"
    now = {c: [(c, 0, 10 + c, 1500.0), (c, 10 + c, 20 + c, 100.0)] for c in range(1, 8)}
    definition = ReportDefinition("r", [RPM], [Event("high", "interval", [Threshold("rpm", ">", 1000)])], [Histogram1D("h", "rpm", BINS, event="high")])

    def run(states):
        data = spark.createDataFrame([r for c in states for r in now[c]], kind)
        sessions = spark.createDataFrame(list(states.items()), "container_id bigint, stop_dt bigint")
        return ReportRun(spark, definition, lambda tags: SampleSeries(data, TimeGrid(1000)), sessions, str(tmp_path / "gold"), max_sessions=2)

    def facts(job):
        return {c: v for c, v in job.table("histogram_fact").where("hist_value > 0").select("container_id", "hist_value").collect()}

    job = run({1: 5, 2: 5, 3: 5})
    assert job.run() == [1, 2] and facts(job) == {1: 11.0, 2: 12.0, 3: 13.0}
    assert job.run() == [] and facts(job) == {1: 11.0, 2: 12.0, 3: 13.0}
    now[2] = [(2, 0, 99, 1500.0)]
    job = run({1: 5, 2: 6, 3: 5, 4: 5, 5: 5})
    spark.createDataFrame([(1, 4, 0, 0.0, 1.0, "x", 77.0)], "visual_id int, container_id bigint, bin_id int, lower_bound double, upper_bound double, bin_name string, hist_value double").write.parquet(
        str(tmp_path / "gold" / "histogram_fact" / "batch=3")
    )
    assert facts(job) == {1: 11.0, 2: 12.0, 3: 13.0}  # batch 3 has no entry in the ledger
    assert job.run() == [3, 4] and facts(job) == {1: 11.0, 2: 99.0, 3: 13.0, 4: 14.0, 5: 15.0}
    assert job.table("interval_event_fact").count() == 5 and job.table("interval_event_dimension").count() == 1


def test_session_batches_are_numbered_in_order(spark):
    rows = spark.range(1003).select(F.pmod(F.col("id") * 379, F.lit(1003)).alias("container_id"))
    got = session_batches(rows, 100, ["container_id"]).collect()
    assert len(got) == 1003 and all(r["batch"] == r["container_id"] // 100 for r in got)
    assert session_batches(rows.limit(0), 100, ["container_id"]).count() == 0


def test_bucketed_tables_need_no_shuffle(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 37).alias("container_id"), F.col("id").alias("tstart"), (F.col("id") % 5).cast("double").alias("value"))
    table = BucketedTable(spark, str(tmp_path / "t"), "container_id", ["tstart"], 4)
    table.write(rows)
    table.write(rows)
    spark.sql(f"DROP TABLE {table.name}")  # another session does not know it
    back = BucketedTable(spark, str(tmp_path / "t"), "container_id", ["tstart"], 4).read()
    runs_ = encode_runs(back.select("container_id", F.lit(1).alias("channel_id"), F.col("tstart").alias("time"), "value"), TimeGrid(1000), ("container_id",))
    totals = SampleSeries(runs_, TimeGrid(1000)).scalars()
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert totals.count() == 37 and back.count() == 3000
    joined = back.groupBy("container_id").count().join(back, "container_id")
    assert "Exchange hashpartitioning" not in joined.hint("merge")._jdf.queryExecution().executedPlan().toString()


def test_empty_histogram_has_share_zero(spark):
    fact = spark.createDataFrame([(1, 1, 0, 0.0, 1.0, "0 - 1", 0.0)], "visual_id int, container_id int, bin_id int, lower_bound double, upper_bound double, bin_name string, hist_value double")
    dim = spark.createDataFrame([(1, "h", "histogram_duration")], "visual_id int, name string, agg_type string")
    assert R.rollup_1d(fact, dim, 1000).first()["relative_pct"] == 0.0
    assert R.validate_histograms(fact, dim).first()["status"] == "EMPTY"


def test_statistics_rollup(spark):
    rows = [(1, "c", label, v) for label in ("min", "max", "mean", "count") for v in (1.0, 4.0)]
    fact = spark.createDataFrame(rows, "visual_id int, channel_name string, aggregation_label string, statistic_value double")
    dim = spark.createDataFrame([(1, "s")], "visual_id int, name string")
    got = {r["aggregation_label"]: r["value"] for r in R.rollup_statistics(fact, dim).collect()}
    assert got == {"min": 1.0, "max": 4.0, "mean": 2.5, "count": 5.0}


def test_diagnosis(spark):
    some, none = spark.range(3), spark.range(0)
    assert R.diagnose(some, some, some).first()["meaning"] == "processed"
    assert R.diagnose(some, some, none).first()["meaning"] == "no values"
    assert R.diagnose(some, none, none).first()["meaning"] == "no definitions"
    assert R.diagnose(none, none, none).first()["meaning"] == "no sessions"


def test_verdicts(spark):
    df = spark.createDataFrame([(0.0,), (0.99,), (1.0,), (5.0,), (20.0,), (20.1,), (None,)], "d double")
    assert [r[0] for r in df.select(verdict(F.col("d"))).collect()] == [
        "MATCH", "MATCH", "CLOSE", "INVESTIGATE", "INVESTIGATE", "FAIL", "FAIL",
    ]


def test_array_texts(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("",), (None,), ("no",)], "t string")
    assert [r[0] for r in df.select(R.array_of_text(F.col("t"))).collect()] == [["a", "b"], [], [], []]


@pytest.mark.parametrize(
    "units,sides",
    [
        (["rpm", "rpm"], ["left", "left"]),
        (["rpm", "km"], ["left", "right"]),
        (["rpm", "km", "km"], ["right", "left", "left"]),
        (["rpm", "km", ""], ["right", "left", "left"]),
    ],
)
def test_axes(spark, units, sides):
    rows = [(i, u, 0.0, {"rpm": 8000.0, "km": 10.0}.get(u, 1.0)) for i, u in enumerate(units)]
    df = spark.createDataFrame(rows, "channel_id int, unit string, min_value double, max_value double")
    assert [r["axis"] for r in assign_axes(df).orderBy("channel_id").collect()] == sides


def test_default_x(spark):
    df = spark.createDataFrame([(0, "speed"), (1, "Odometer")], "position int, channel_name string")
    assert default_x_channel(df).first()[0] == "Odometer"
    assert default_x_channel(df.where("position = 0")).first()[0] == "speed"


def test_families(spark):
    rows = [("Eng_nmot_1", "rpm", 0.0, 6500.0), ("BattSOC", "%", 0.0, 400.0), ("xyz", "", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "channel_name string, unit string, min_value double, max_value double")
    known = [
        ("drive", "speed of rotation", ["NMOT", "turns"], ["rpm"], 0.0, 8000.0),
        ("battery", "charge", ["soc"], ["%"], 0.0, 100.0),
        ("any", "x", ["x"], [], None, None),
    ]
    kind = "domain string, signal string, patterns array<string>, units array<string>, lo double, hi double"
    got = {(r["channel_name"], r["signal"]): r["score"] for r in match_families(df, spark.createDataFrame(known, kind)).collect()}
    assert got == {("Eng_nmot_1", "speed of rotation"): 2, ("BattSOC", "charge"): 1, ("xyz", "x"): 0}


def test_profile_rules():
    for kwargs in (
        {"tags": TagMap(container_table=None)},
        {"vehicle": VehicleRule("column")},
        {"vehicle": VehicleRule("constant")},
        {"vehicle": VehicleRule("guess")},
    ):
        with pytest.raises(ValueError):
            Profile(**kwargs)


def test_profile_overrides_and_renames():
    base = Profile(channels=ChannelMap(container_id="sid"), series=SeriesMap(time="ts", end=None))
    assert base.override({"series.time": None}) == base
    assert base.override_source({"series.value": "v / 2", "vehicle.column": "x"}).series.value == "v / 2"
    with pytest.raises(KeyError):
        base.override({"series.nothing": "x"})
    assert base.renames() == {"channel_metrics": {"sid": "container_id"}, "channels": {"sid": "container_id", "ts": "tstart"}}
    assert Profile().renames() == {}
    assert Profile().aliases == AliasMap()


def test_grid_is_part_of_a_series(spark):
    assert runs(spark, TimeGrid(10), []).grid == TimeGrid(10)

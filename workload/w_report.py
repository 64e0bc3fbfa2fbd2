"""Histograms, statistics, reports and their validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.binning import bin_index
from seriesloom.operators import histograms as H
from seriesloom.operators.statistics import LABELS, event_statistics, typed_statistics
from seriesloom.plans import compare as C
from seriesloom.plans import rollups as R
from seriesloom.plans.catalog import MeasurementCatalog
from seriesloom.plans.charts import default_x_channel, statistics_over
from seriesloom.plans.definitions import Event, Histogram1D, Histogram2D, ReportDefinition, Signal, Statistics, Threshold
from seriesloom.plans.profile import Profile
from seriesloom.plans.report import Report, channel_source, new_and_changed, session_batches
from seriesloom.plans.report_run import ReportRun
from seriesloom.sources.scratch import scratch_folder
from workload.model import HOUR, TICKS
from workload.registry import query
from workload.sql import at_points, bin_case, bin_values, edges, histogram, meet, sql

BINS = (0, 10, 20, 50, 100, 200)
LEVEL_BINS = (0, 1, 2, 3, 4)
HOUR_BINS = (0, 6 * HOUR, 24 * HOUR, 72 * HOUR, 720 * HOUR)
CLIPPED = "a.container_id AS container_id, a.value AS v, e - s AS w"


# -- histograms ------------------------------------------------------------------------------------------------------
@query(
    "h1_duration_histogram",
    sql("SELECT * FROM x", "r AS (SELECT container_id, value AS v, tend - tstart AS w FROM s_click)", histogram("x", "r", BINS)),
)
def _(d):
    return H.duration_histogram(d.signal("click"), BINS)


@query(
    "h1_duration_histogram_masked_and_capped",
    sql(
        "SELECT * FROM x",
        meet("m", "s_click", "busy", CLIPPED),
        f"r AS (SELECT container_id, v, least(w, {12 * HOUR}) AS w FROM m)",
        histogram("x", "r", BINS),
    ),
)
def _(d):
    return H.duration_histogram(d.signal("click"), BINS, d.busy(), 12 * HOUR)


@query(
    "h2_distance_histogram",
    sql(
        "SELECT * FROM x",
        """st AS (SELECT container_id, tstart AS t, coalesce(value - lag(value) OVER (PARTITION BY container_id ORDER BY tstart, tend), 0) AS step FROM odo)""",
        at_points("r", "st", "s_click", columns="p.container_id, r.value AS v, p.step AS w"),
        histogram("x", "r", BINS),
    ),
)
def _(d):
    return H.distance_histogram(d.signal("click"), d.odometer, BINS)


@query(
    "h3_duration_count_histogram",
    sql(
        "SELECT container_id, bin_id, lower_bound, upper_bound, hist_value FROM x",
        "r AS (SELECT container_id, tend - tstart AS v, 1 AS w FROM hot)",
        histogram("x", "r", HOUR_BINS),
    ),
)
def _(d):
    return H.duration_count_histogram(d.hot(), HOUR_BINS).drop("bin_name")


@query(
    "h4_event_count_histogram",
    sql(
        "SELECT * FROM x",
        edges("p", "s_view", "value > pv"),
        at_points("r", "p", "s_click", columns="p.container_id, r.value AS v, 1 AS w"),
        histogram("x", "r", BINS),
    ),
)
def _(d):
    return H.event_count_histogram(d.signal("click"), d.signal("view").rising_edges(), BINS)


def joint_sql(rows: str, axes: dict[str, tuple[str, tuple]]) -> str:
    """Dense joint histogram of rows with a weight w; axes: prefix -> (value column, bins)."""
    cross = " CROSS JOIN ".join(bin_values(b, p) for p, (_, b) in axes.items())
    cols = ", ".join(f"{p}bin_id, {p}lower_bound, {p}upper_bound, {p}bin_name" for p in axes)
    bins = ", ".join(f"{bin_case(v, b)} AS b{p}" for p, (v, b) in axes.items())
    on = " AND ".join(f"h.b{p} = {p}bin_id" for p in axes)
    return f"""SELECT c.container_id, {cols}, coalesce(h.w, 0)::DOUBLE AS hist_value
FROM (SELECT DISTINCT container_id FROM {rows}) c CROSS JOIN {cross}
LEFT JOIN (SELECT container_id, {bins}, sum(w) AS w FROM {rows} GROUP BY ALL) h ON h.container_id = c.container_id AND {on}"""


XY = "a.container_id AS container_id, a.value AS x, b.value AS y, e - s AS w"


@query("h5_joint_histogram", sql(joint_sql("r", {"x_": ("x", BINS), "y_": ("y", BINS)}), meet("r", "s_click", "s_view", XY)))
def _(d):
    return H.joint_histogram([d.signal("click"), d.signal("view")], [BINS, BINS])


@query(
    "h6_joint_histogram_3d",
    sql(
        joint_sql("r", {"x_": ("x", BINS), "y_": ("y", BINS), "z_": ("z", LEVEL_BINS)}),
        """r AS (SELECT a.container_id, a.value AS x, b.value AS y, c.value AS z,
  least(a.tend, b.tend, c.tend) - greatest(a.tstart, b.tstart, c.tstart) AS w
FROM s_click a JOIN s_view b ON a.container_id = b.container_id AND a.tstart < b.tend AND b.tstart < a.tend
JOIN l_error c ON a.container_id = c.container_id AND greatest(a.tstart, b.tstart) < c.tend AND c.tstart < least(a.tend, b.tend)
WHERE a.tend > a.tstart AND b.tend > b.tstart AND c.tend > c.tstart)""",
    ),
)
def _(d):
    return H.joint_histogram([d.signal("click"), d.signal("view"), d.level("error")], [BINS, BINS, LEVEL_BINS])


@query(
    "h7_point_histogram",
    sql(
        "SELECT * FROM x",
        edges("p", "s_view", "value < pv"),
        at_points("r", "p", "s_click", columns="p.container_id, r.value AS v, 2.5 AS w"),
        histogram("x", "r", BINS),
    ),
)
def _(d):
    return H.pit_histogram(d.signal("click").where(d.signal("view").falling_edges()), BINS, weight_const=2.5)


@query(
    "h7_joint_point_histogram",
    sql(
        joint_sql("r", {"x_": ("x", BINS), "y_": ("y", BINS)}),
        edges("p", "s_view", "value > pv"),
        at_points("q", "p", "s_click"),
        at_points("r", "q", "s_error", columns="p.container_id, p.value AS x, r.value AS y, 1 AS w"),
    ),
)
def _(d):
    pits = d.signal("click").where(d.signal("view").rising_edges())
    return H.joint_pit_histogram(pits, [d.signal("error")], [BINS, BINS])


# -- statistics ------------------------------------------------------------------------------------------------------
def stats_sql(rows: str, keys: str) -> str:
    """Long statistics of rows with keys, v and w (weights)."""
    part = f"PARTITION BY {keys}"
    return f"""WITH_MARK base AS (SELECT *, sum(w) OVER ({part}) AS tw, count(*) OVER ({part}) AS tn,
    sum(w) OVER ({part} ORDER BY v, i ROWS UNBOUNDED PRECEDING) AS cw, row_number() OVER ({part} ORDER BY v, i) AS cn,
    CASE WHEN sum(w) OVER ({part}) > 0 THEN sum(v * w) OVER ({part}) / sum(w) OVER ({part}) ELSE avg(v) OVER ({part}) END AS mu
  FROM (SELECT *, row_number() OVER () AS i FROM {rows})),
agg AS (SELECT {keys}, min(v) AS "min", max(v) AS "max", min(mu) AS "mean",
  min(v) FILTER (CASE WHEN tw > 0 THEN cw * 2 >= tw ELSE cn * 2 >= tn END) AS "median",
  sqrt(CASE WHEN sum(w) > 0 THEN sum(w * (v - mu) ^ 2) / sum(w) ELSE avg((v - mu) ^ 2) END) AS "std",
  count(*)::DOUBLE AS "count" FROM base GROUP BY {keys})
SELECT {keys}, aggregation_label, round(statistic_value, 4) AS statistic_value FROM agg
UNPIVOT (statistic_value FOR aggregation_label IN ("min", "max", "mean", "median", "std", "count"))"""


def stats_ctes(rows: str, keys: str) -> tuple[str, str]:
    """The same as expressions to select from: the last is called shown."""
    head, _, select = stats_sql(rows, keys).removeprefix("WITH_MARK ").partition("\nSELECT ")
    return head, f"shown AS (SELECT {select})"


def with_stats(rows: str, keys: str, *ctes: str) -> str:
    body = stats_sql(rows, keys).removeprefix("WITH_MARK ")
    head, _, select = body.partition("\nSELECT ")
    return sql("SELECT " + select, *ctes, head)


def rounded_value():
    return F.round("statistic_value", 4).alias("statistic_value")


NAMED = "a.container_id AS container_id, b.tstart AS event_start, '{0}' AS channel_name, a.value AS v, e - s AS w"


def _event_stats(d, event, labels=LABELS) -> DataFrame:
    return event_statistics({"click": d.signal("click"), "error": d.signal("error")}, event, labels)


@query(
    "t1_event_statistics",
    with_stats(
        "r",
        "container_id, event_number, channel_name",
        meet("m1", "s_click", "busy", NAMED.format("click")),
        meet("m2", "s_error", "busy", NAMED.format("error")),
        "n AS (SELECT container_id, tstart AS event_start, row_number() OVER (PARTITION BY container_id ORDER BY tstart) AS event_number FROM busy)",
        "r AS (SELECT * FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) JOIN n USING (container_id, event_start))",
    ),
)
def _(d):
    numbers = d.busy().instances().select("container_id", "event_number", "event_instance_id")
    stats = _event_stats(d, d.busy()).join(numbers, ["container_id", "event_instance_id"])
    return stats.select("container_id", "event_number", "channel_name", "aggregation_label", rounded_value())


@query(
    "t1_whole_recording_statistics",
    with_stats(
        "r",
        "container_id, channel_name",
        """r AS (SELECT container_id, 'click' AS channel_name, value AS v, tend - tstart AS w FROM s_click
UNION ALL SELECT container_id, 'error', value, tend - tstart FROM s_error)""",
    ),
)
def _(d):
    return _event_stats(d, None).select("container_id", "channel_name", "aggregation_label", rounded_value())


@query(
    "t2_weighted_median",
    sql(
        """SELECT container_id, min(value) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY container_id) AS tw, count(*) OVER (PARTITION BY container_id) AS tn,
  sum(w) OVER (PARTITION BY container_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS cw,
  count(*) OVER (PARTITION BY container_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS cn
FROM (SELECT container_id, value, tend - tstart AS w FROM s_view))
WHERE CASE WHEN tw > 0 THEN cw * 2 >= tw ELSE cn * 2 >= tn END GROUP BY container_id"""
    ),
)
def _(d):
    out = typed_statistics(d.signal("view"), ["median"])
    return out.select("container_id", F.col("statistic_value").alias("median"))


@query(
    "t3_point_event_statistics",
    with_stats(
        "r",
        "container_id, event_number, channel_name",
        edges("p", "s_view", "value > pv"),
        "n AS (SELECT container_id, t, row_number() OVER (PARTITION BY container_id ORDER BY t) AS event_number FROM p)",
        at_points("r1", "n", "s_click", columns="p.container_id, p.event_number, 'click' AS channel_name, r.value AS v, 1 AS w"),
        at_points("r2", "n", "s_error", columns="p.container_id, p.event_number, 'error' AS channel_name, r.value AS v, 1 AS w"),
        "r AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)",
    ),
)
def _(d):
    points = d.signal("view").rising_edges()
    numbers = points.instances().select("container_id", "event_number", "event_instance_id")
    stats = _event_stats(d, points).join(numbers, ["container_id", "event_instance_id"])
    return stats.select("container_id", "event_number", "channel_name", "aggregation_label", rounded_value())


@query(
    "t4_statistics_by_type",
    sql(
        "SELECT kind, container_id, aggregation_label, round(statistic_value, 1) AS statistic_value FROM shown UNION ALL SELECT 'points', container_id, 'count', count(*)::DOUBLE FROM p GROUP BY container_id",
        edges("p", "s_view", "value > pv"),
        at_points("x", "p", "s_click"),
        "r AS (SELECT 'intervals' AS kind, container_id, (tend - tstart)::DOUBLE AS v, 1 AS w FROM hot UNION ALL SELECT 'point values', container_id, value, 1 FROM x)",
        *stats_ctes("r", "kind, container_id"),
    ),
)
def _(d):
    points = d.signal("view").rising_edges()
    kinds = {"intervals": d.hot(), "points": points, "point values": d.signal("click").where(points)}
    out = None
    for kind, operand in kinds.items():
        part = typed_statistics(operand, LABELS).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("statistic_value", F.round("statistic_value", 1))


# -- report ----------------------------------------------------------------------------------------------------------
def definition() -> ReportDefinition:
    return ReportDefinition(
        "drive",
        signals=[
            Signal("click", channel={"channel_name": "click"}, label="Click rate"),
            Signal("view", channel={"channel_name": "view"}),
            Signal("doubled", build=lambda s: s["click"] * 2),
            Signal("never", build=lambda s: s["click"] * 0 - 1),
        ],
        events=[
            Event("busy", "interval", [Threshold("view", ">", 30)]),
            Event("hot_and_busy", "interval", [Threshold("click", ">", 40), Threshold("view", ">", 30)]),
            Event("rise", "rising_edges", [Threshold("view", ">", 30)]),
        ],
        aggregations=[
            Histogram1D("click_time", "click", BINS, bins_unit="rpm", values_unit="s"),
            Histogram1D("click_busy", "doubled", BINS, event="busy", bins_unit="rpm"),
            Histogram1D("busy_count", None, HOUR_BINS, kind="duration_count", event="busy"),
            Histogram1D("nothing", "never", BINS),
            Histogram1D("click_at_rise", "click", BINS, kind="event_count", event="rise"),
            Histogram2D("click_view", "click", "view", BINS, BINS, x_bins_unit="rpm", y_bins_unit="km/h"),
            Statistics("overview", ["click", "view"], ["min", "max", "mean", "count"], event="busy"),
        ],
    )


def channels_of(d):
    """The channels of the written runs, found by their written tags."""
    catalog = MeasurementCatalog({"channel_tags": d.silver_tags}, Profile(ticks_per_second=TICKS))
    return channel_source(d.silver, catalog.channels_matching, d.grid)


def report_of(d) -> Report:
    if "report" not in d.memo:
        d.memo["report"] = Report(d.spark, definition(), channels_of(d), d.container_metrics)
    return d.memo["report"]


def tables_of(d) -> dict[str, DataFrame]:
    """The report as written tables, so that what reads it does not compute it again."""
    if "report_tables" not in d.memo:
        paths = report_of(d).write(scratch_folder(d.spark, "report"))
        d.memo["report_tables"] = {n: d.spark.read.parquet(p) for n, p in paths.items()}
    return d.memo["report_tables"]


REPORT_CTES = (
    "r1 AS (SELECT container_id, value AS v, tend - tstart AS w FROM s_click)",
    histogram("h1", "r1", BINS),
    meet("r2", "s_click", "busy", "a.container_id AS container_id, a.value * 2 AS v, e - s AS w"),
    histogram("h2", "r2", BINS),
    "r3 AS (SELECT container_id, tend - tstart AS v, 1 AS w FROM busy)",
    histogram("h3", "r3", HOUR_BINS),
    "r4 AS (SELECT container_id, -1 AS v, tend - tstart AS w FROM s_click)",
    histogram("h4", "r4", BINS),
    "p5 AS (SELECT container_id, tstart AS t FROM busy)",
    at_points("r5", "p5", "s_click", columns="p.container_id, r.value AS v, 1 AS w"),
    histogram("h5", "r5", BINS),
    "fact AS (" + " UNION ALL ".join(f"SELECT {i} AS visual_id, * FROM h{i}" for i in range(1, 6)) + ")",
    f"""dim AS (SELECT * FROM (VALUES (1, 'click_time', 'histogram_duration', 'rpm', 's'), (2, 'click_busy', 'histogram_duration', 'rpm', NULL),
  (3, 'busy_count', 'histogram_duration_count', NULL, NULL), (4, 'nothing', 'histogram_duration', NULL, NULL),
  (5, 'click_at_rise', 'histogram_event_count', NULL, NULL)) AS t(visual_id, name, agg_type, bins_unit, values_unit))""",
    meet("r6", "s_click", "s_view", XY),
    "fact2 AS (" + joint_sql("r6", {"x_": ("x", BINS), "y_": ("y", BINS)}) + ")",
    meet("m1", "s_click", "busy", NAMED.format("Click rate")),
    meet("m2", "s_view", "busy", NAMED.format("view")),
    """stat AS (SELECT container_id, event_start, channel_name, min(v) AS mi, max(v) AS ma, sum(v * w) / sum(w) AS me, count(*) AS n
  FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY ALL)""",
)

FACT_SELECT = """SELECT visual_id, container_id, bin_id, lower_bound, upper_bound,
  CASE WHEN visual_id = 3 THEN '' ELSE bin_name END AS bin_name, hist_value FROM fact"""


@query("s21_write_star_schema", sql(FACT_SELECT, *REPORT_CTES))
def _(d):
    no_hours = F.when(F.col("visual_id") == 3, F.lit("")).otherwise(F.col("bin_name"))
    return tables_of(d)["histogram_fact"].withColumn("bin_name", no_hours)


@query(
    "r1_report_rollup",
    sql(
        """SELECT name, bin_id, lower_bound, upper_bound, round(v / CASE WHEN agg_type = 'histogram_duration' THEN 1e6 ELSE 1 END, 3) AS hist_value,
  round(CASE WHEN sum(v) OVER (PARTITION BY name) > 0 THEN v / sum(v) OVER (PARTITION BY name) * 100 ELSE 0 END, 6) AS relative_pct
FROM (SELECT name, agg_type, bin_id, lower_bound, upper_bound, sum(hist_value) AS v FROM fact JOIN dim USING (visual_id) GROUP BY ALL)""",
        *REPORT_CTES,
    ),
)
def _(d):
    report = report_of(d)
    rows = R.rollup_1d(next(report.facts(Histogram1D)), report.dimensions()["histogram_dimension"], TICKS)
    return _rolled(rows).drop("bin_name")


def _rolled(rows):
    return rows.withColumn("hist_value", F.round("hist_value", 3)).withColumn("relative_pct", F.round("relative_pct", 6))


@query(
    "r2_duration_scaling",
    sql(
        "SELECT container_id, bin_id, round(hist_value / 1e6, 3) AS seconds FROM fact WHERE visual_id = 1",
        *REPORT_CTES,
    ),
)
def _(d):
    fact = tables_of(d)["histogram_fact"].where(F.col("visual_id") == 1)
    return fact.select("container_id", "bin_id", F.round(d.grid.seconds(F.col("hist_value")), 3).alias("seconds"))


@query(
    "r3_report_matrix",
    sql(
        """SELECT 'click_view' AS name, x_bin_id, y_bin_id, round(sum(hist_value) / 1e6, 3) AS hist_value
FROM fact2 GROUP BY x_bin_id, y_bin_id""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    rows = R.rollup_2d(t["histogram2d_fact"], t["histogram2d_dimension"], TICKS)
    return rows.withColumn("hist_value", F.round("hist_value", 3))


@query(
    "r4_statistics_rollup",
    sql(
        """SELECT 'overview' AS name, channel_name, 'min' AS aggregation_label, min(mi) AS value FROM stat GROUP BY channel_name
UNION ALL SELECT 'overview', channel_name, 'max', max(ma) FROM stat GROUP BY channel_name
UNION ALL SELECT 'overview', channel_name, 'mean', round(avg(me), 6) FROM stat GROUP BY channel_name
UNION ALL SELECT 'overview', channel_name, 'count', sum(n)::DOUBLE FROM stat GROUP BY channel_name""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    rows = R.rollup_statistics(t["stats_aggregator_fact"], t["stats_aggregator_dimension"])
    return rows.withColumn("value", F.round("value", 6))


@query(
    "r5_validate_histograms",
    sql(
        """SELECT name, count(DISTINCT container_id) AS sessions, round(sum(hist_value), 2) AS total_value,
  count(*) FILTER (hist_value > 0) AS non_zero_bins, CASE WHEN sum(hist_value) > 0 THEN 'OK' ELSE 'EMPTY' END AS status
FROM fact JOIN dim USING (visual_id) GROUP BY name""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    return R.validate_histograms(t["histogram_fact"], t["histogram_dimension"])


@query(
    "r5_histogram_summary",
    sql(
        """SELECT name, bins_unit, values_unit, count(DISTINCT container_id) AS session_count, count(*) AS bin_count,
  sum(hist_value) AS total_value, max(hist_value) AS max_value, min(hist_value) FILTER (hist_value > 0) AS min_nonzero_value
FROM fact JOIN dim USING (visual_id) GROUP BY ALL""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    return R.histogram_summary(t["histogram_fact"], t["histogram_dimension"])


@query(
    "r5_row_counts",
    sql(
        "SELECT 'histogram_dimension' AS tbl, count(*) AS cnt FROM dim UNION ALL SELECT 'histogram_fact', count(*) FROM fact",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    return R.row_counts({n: t[n] for n in ("histogram_dimension", "histogram_fact")})


@query(
    "r6_diagnosis",
    sql(
        """SELECT (SELECT count(*) FROM cm) AS sessions, (SELECT count(*) FROM dim) AS histogram_dim,
  (SELECT count(*) FROM fact) AS histogram_fact, 'processed' AS meaning""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    return R.diagnose(t["measurement_dimension"], t["histogram_dimension"], t["histogram_fact"])


@query(
    "r6_missing_signals",
    sql(
        """SELECT DISTINCT channel_name FROM bronze WHERE channel_name NOT IN
  (SELECT channel_name FROM chm WHERE container_id IN (SELECT container_id FROM cm ORDER BY lo, container_id LIMIT 1) AND sample_count > 12)"""
    ),
)
def _(d):
    first = d.container_metrics.agg(F.min_by("container_id", F.struct("start_dt", "container_id")).alias("container_id"))
    wanted = d.samples.select("channel_name").distinct()
    long_enough = d.channel_metrics.where(F.col("sample_count") > 12)
    return R.missing_signals(wanted, long_enough, first)


@query(
    "r7_list_aggregations",
    sql(
        """SELECT visual_id, name, 'histogram_1d' AS agg_type, agg_type AS type, '' AS description, coalesce(bins_unit, '') AS bins_unit,
  coalesce(values_unit, '') AS values_unit, '' AS x_bins_unit, '' AS y_bins_unit FROM dim
UNION ALL SELECT 6, 'click_view', 'histogram_2d', 'duration', '', '', '', 'rpm', 'km/h'
UNION ALL SELECT 7, 'overview', 'statistics', '', '', '', '', '', ''""",
        *REPORT_CTES,
    ),
)
def _(d):
    return R.list_aggregations(tables_of(d))


@query(
    "j6_fact_with_dimension",
    sql(
        "SELECT name, container_id, bin_id, hist_value FROM fact JOIN dim USING (visual_id) WHERE name = 'click_busy'",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    dim = t["histogram_dimension"].where(F.col("name") == "click_busy").select("visual_id", "name")
    return t["histogram_fact"].join(dim, "visual_id").select("name", "container_id", "bin_id", "hist_value")


def sessions_of(d) -> DataFrame:
    """Recordings with first and last mileage."""
    km = d.odometer.frame.groupBy("container_id").agg(F.min("value").alias("start_km"), F.max("value").alias("end_km"))
    return d.container_metrics.join(km, "container_id", "left")


SESSIONS = """ses AS (SELECT cm.*, min(value) AS start_km, max(value) AS end_km FROM cm LEFT JOIN odo USING (container_id) GROUP BY ALL)"""


@query(
    "j7_rollup_by_vehicle",
    sql(
        """SELECT name, vehicle_key, bin_id, round(v / 1e6, 3) AS hist_value,
  round(CASE WHEN sum(v) OVER (PARTITION BY name, vehicle_key) > 0 THEN v / sum(v) OVER (PARTITION BY name, vehicle_key) * 100 ELSE 0 END, 6) AS relative_pct
FROM (SELECT name, vehicle_key, bin_id, sum(hist_value) AS v FROM fact JOIN dim USING (visual_id) JOIN ses USING (container_id)
  WHERE name IN ('click_time', 'click_busy') AND lo >= epoch_us(TIMESTAMP '2024-01-01 12:00:00') AND hi <= epoch_us(TIMESTAMP '2024-01-30 22:00:00')
    AND start_km >= 5 AND end_km <= 1000 GROUP BY ALL)""",
        *REPORT_CTES,
        SESSIONS,
    ),
)
def _(d):
    t = tables_of(d)
    fact = R.select_sessions(
        t["histogram_fact"],
        sessions_of(d),
        start="2024-01-01 12:00:00",
        stop="2024-01-30 22:00:00",
        min_km=5,
        max_km=1000,
    )
    rows = R.rollup_1d(fact, t["histogram_dimension"], TICKS, ["click_time", "click_busy"], by=["vehicle_key"])
    return _rolled(rows).select("name", "vehicle_key", "bin_id", "hist_value", "relative_pct")


@query(
    "w3_share_of_total",
    sql(
        """SELECT container_id, bin_id, round(CASE WHEN sum(hist_value) OVER (PARTITION BY container_id) > 0
  THEN hist_value / sum(hist_value) OVER (PARTITION BY container_id) * 100 ELSE 0 END, 6) AS relative_pct FROM fact WHERE visual_id = 1""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    rows = R.rollup_1d(t["histogram_fact"], t["histogram_dimension"], TICKS, ["click_time"], by=["container_id"])
    return rows.select("container_id", "bin_id", F.round("relative_pct", 6).alias("relative_pct"))


@query(
    "v1_statistics_over_x",
    sql(
        """SELECT x.container_id, x.event_start AS tstart, y.channel_name, round(x.mi, 4) AS x, y.mi AS min, y.ma AS max, round(y.me, 4) AS mean
FROM stat x JOIN stat y USING (container_id, event_start) WHERE x.channel_name = 'view' AND y.channel_name = 'Click rate'""",
        *REPORT_CTES,
    ),
)
def _(d):
    t = tables_of(d)
    wide = statistics_over(t["stats_aggregator_fact"], "view", ["min", "max", "mean"])
    events = t["interval_event_fact"].where(F.col("event_name") == "busy")
    rows = wide.join(events.select("container_id", "tstart", "event_instance_id"), "event_instance_id")
    return rows.select(
        "container_id", "tstart", "channel_name", F.round("x", 4).alias("x"), "min", "max", F.round("mean", 4).alias("mean")
    )


@query(
    "v2_default_x_channel",
    """SELECT coalesce(min(p_name) FILTER (regexp_matches(p_name, '(?i)distance|odometer|odo|km')), min(p_name)) AS x_channel FROM part""",
)
def _(d):
    names = d.table("part").select(F.col("p_name").alias("channel_name")).distinct()
    return default_x_channel(names, order="channel_name")


# -- expected against actual -----------------------------------------------------------------------------------------
LINE_BINS = (0, 10, 20, 30, 40, 51)
SIDES = {"expected": "l_linenumber <= 6", "actual": "l_linenumber >= 2 OR l_returnflag <> 'R'"}


def sides_of(d) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Two reports over orders: quantities (or prices) per return flag, from two selections of the lines."""
    out = {}
    for side, condition in SIDES.items():
        lines = d.table("lineitem").where(F.expr(condition))
        if side == "actual":
            lines = lines.where((F.col("l_returnflag") != "A") | (F.col("l_orderkey") % 10 != 0))
        shift = 0 if side == "expected" else 10
        name = F.when(F.col("l_returnflag") == "A", F.lit("flag_A")).otherwise(
            F.concat(F.lit("flag_"), "l_returnflag") if side == "expected" else F.lit("flag_N")
        )
        rows = lines.select(
            F.col("l_orderkey").alias("container_id"),
            name.alias("name"),
            bin_index(F.col("l_quantity"), LINE_BINS).alias("bin_id"),
            "l_quantity",
        )
        ids = F.ascii(F.substring("name", 6, 1)) + shift
        fact = rows.groupBy(ids.alias("visual_id"), "container_id", "bin_id").agg(F.sum("l_quantity").alias("hist_value"))
        fact = fact.withColumn("lower_bound", F.get(F.array(*[F.lit(float(b)) for b in LINE_BINS]), F.col("bin_id")))
        fact = fact.withColumn("upper_bound", F.get(F.array(*[F.lit(float(b)) for b in LINE_BINS]), F.col("bin_id") + 1))
        dim = rows.select(ids.alias("visual_id"), "name").distinct().withColumn("agg_type", F.lit("histogram_" + side))
        out[side] = (fact, dim)
    return out


def _side_sql(side: str) -> str:
    name = (
        "'flag_' || l_returnflag" if side == "expected" else "CASE WHEN l_returnflag = 'A' THEN 'flag_A' ELSE 'flag_N' END"
    )
    more = "" if side == "expected" else " AND (l_returnflag <> 'A' OR l_orderkey % 10 <> 0)"
    return f"""{side} AS (SELECT name, container_id, b AS bin_id, sum(q) AS v FROM (
  SELECT l_orderkey AS container_id, {name} AS name, {bin_case('l_quantity', LINE_BINS)} AS b, l_quantity AS q
  FROM lineitem WHERE ({SIDES[side]}){more}) GROUP BY ALL)"""


def side_sql(select: str) -> str:
    return f"WITH {_side_sql('expected')}, {_side_sql('actual')}\n{select}"


@query(
    "j9_match_definitions",
    side_sql(
        """SELECT histogram_name, bool_or(side = 0) AS in_expected, bool_or(side = 1) AS in_actual,
  max(kind) FILTER (side = 0) AS expected_type, max(kind) FILTER (side = 1) AS actual_type
FROM (SELECT name AS histogram_name, 0 AS side, 'histogram_expected' AS kind FROM expected UNION SELECT name, 1, 'histogram_actual' FROM actual)
GROUP BY histogram_name"""
    ),
)
def _(d):
    s = sides_of(d)
    return C.match_definitions(s["expected"][1], s["actual"][1])


@query(
    "j10a_compare_totals",
    side_sql(
        """SELECT *, CASE WHEN deviation_pct < 1 THEN 'MATCH' WHEN deviation_pct < 5 THEN 'CLOSE' WHEN deviation_pct <= 20 THEN 'INVESTIGATE' ELSE 'FAIL' END AS verdict
FROM (SELECT coalesce(e.name, a.name) AS histogram_name, e.t AS expected_total, a.t AS actual_total, e.s AS expected_sessions, a.s AS actual_sessions,
  e.b AS expected_bins_with_data, a.b AS actual_bins_with_data, CASE WHEN e.t > 0 THEN round(abs(a.t - e.t) / e.t * 100, 2) END AS deviation_pct
FROM (SELECT name, sum(v) t, count(DISTINCT container_id) s, count(DISTINCT bin_id) b FROM expected WHERE v > 0 GROUP BY name) e
FULL JOIN (SELECT name, sum(v) t, count(DISTINCT container_id) s, count(DISTINCT bin_id) b FROM actual WHERE v > 0 GROUP BY name) a ON e.name = a.name)"""
    ),
)
def _(d):
    s = sides_of(d)
    return C.compare_totals(*s["expected"], *s["actual"])


@query(
    "j10b_compare_bins",
    side_sql(
        """SELECT 'flag_A' AS histogram_name, e.container_id, e.bin_id, lo[e.bin_id + 1]::DOUBLE AS lower_bound, lo[e.bin_id + 2]::DOUBLE AS upper_bound,
  e.v AS expected_value, a.v AS actual_value, round(a.v - e.v, 6) AS abs_diff, CASE WHEN e.v > 0 THEN round((a.v - e.v) / e.v * 100, 2) END AS rel_diff_pct
FROM (SELECT *, [0, 10, 20, 30, 40, 51] AS lo FROM expected WHERE name = 'flag_A') e
LEFT JOIN (SELECT * FROM actual WHERE name = 'flag_A') a ON e.container_id = a.container_id AND e.bin_id = a.bin_id
WHERE e.v > 0 OR a.v > 0"""
    ),
)
def _(d):
    s = sides_of(d)
    return C.compare_bins(*s["expected"], *s["actual"], "flag_A")


@query(
    "j10c_one_sided_containers",
    side_sql(
        """SELECT coalesce(e.c, a.c) AS container_id, e.c IS NOT NULL AS in_expected, a.c IS NOT NULL AS in_actual
FROM (SELECT DISTINCT container_id AS c FROM expected WHERE name = 'flag_A') e
FULL JOIN (SELECT DISTINCT container_id AS c FROM actual WHERE name = 'flag_A') a ON e.c = a.c WHERE e.c IS NULL OR a.c IS NULL"""
    ),
)
def _(d):
    named = {}
    for side, (fact, dim) in sides_of(d).items():
        named[side] = fact.join(dim.where(F.col("name") == "flag_A"), "visual_id", "left_semi")
    return C.one_sided(named["expected"], named["actual"])


@query("j10d_all_zero_definitions", sql("SELECT name FROM dim WHERE visual_id NOT IN (SELECT visual_id FROM fact GROUP BY visual_id HAVING sum(hist_value) > 0)", *REPORT_CTES))
def _(d):
    t = tables_of(d)
    return C.all_zero(t["histogram_fact"], t["histogram_dimension"])


@query(
    "u6_two_sided_difference",
    sql(
        """SELECT coalesce(a.c, b.c) AS container_id, a.c IS NOT NULL AS in_expected, b.c IS NOT NULL AS in_actual
FROM (SELECT DISTINCT container_id AS c FROM bronze WHERE value > 250) a
FULL JOIN (SELECT DISTINCT container_id AS c FROM bronze WHERE channel_name = 'click' AND value > 120) b ON a.c = b.c WHERE a.c IS NULL OR b.c IS NULL"""
    ),
)
def _(d):
    high = d.samples.where(F.col("value") > 250)
    click = d.channel_samples("click").where(F.col("value") > 120)
    return C.one_sided(high, click)


# -- incremental -----------------------------------------------------------------------------------------------------
@query(
    "s22_new_and_changed",
    sql(
        """SELECT container_id, hi AS stop_dt, 'inserted' AS change FROM cm WHERE container_id % 3 = 0
UNION ALL SELECT container_id, hi, 'updated' FROM cm WHERE container_id % 3 <> 0 AND container_id % 4 = 0"""
    ),
)
def _(d):
    silver = d.container_metrics.select("container_id", F.unix_micros("stop_dt").alias("stop_dt"))
    gold = silver.where(F.col("container_id") % 3 != 0).withColumn(
        "stop_dt", F.col("stop_dt") - F.when(F.col("container_id") % 4 == 0, 1).otherwise(0)
    )
    return new_and_changed(silver, gold, "stop_dt")


@query(
    "s23_capped_run",
    sql("SELECT container_id, vehicle_key, (row_number() OVER (ORDER BY lo, container_id) - 1)::INTEGER // 250 AS batch FROM cm"),
)
def _(d):
    """Every recording, in runs of 250."""
    rows = d.container_metrics.select("start_dt", "container_id", "vehicle_key")
    return session_batches(rows, 250, ["start_dt", "container_id"]).drop("start_dt")


@query("s23_incremental_report", sql(FACT_SELECT, *REPORT_CTES))
def _(d):
    """The report in two runs of several batches: some recordings come late, some have changed in between."""
    known = d.container_metrics.select("container_id", F.unix_micros("stop_dt").alias("stop_dt"))
    early = known.where(F.col("container_id") % 3 != 0).withColumn(
        "stop_dt", F.col("stop_dt") - F.when(F.col("container_id") % 4 == 0, 1).otherwise(0)
    )
    folder, channel = scratch_folder(d.spark, "incremental"), channels_of(d)
    size = max(1, -(-known.count() // 2))
    for sessions in (early, known):
        run = ReportRun(d.spark, definition(), channel, sessions, folder, max_sessions=size)
        run.run()
    no_hours = F.when(F.col("visual_id") == 3, F.lit("")).otherwise(F.col("bin_name"))
    return run.table("histogram_fact").withColumn("bin_name", no_hours)


@query(
    "s21_event_dimensions",
    """SELECT * FROM (VALUES (1, 'busy', 'interval', 'view > 30', 'interval_event'),
  (2, 'hot_and_busy', 'interval', 'click > 40 AND view > 30', 'interval_event'), (3, 'rise', 'rising_edges', 'view > 30', 'point_event'))
  AS t(event_id, event_name, kind, conditions, tbl)""",
)
def _(d):
    t = tables_of(d)
    parts = [t[f"{n}_dimension"].withColumn("tbl", F.lit(n)) for n in ("interval_event", "point_event")]
    return reduce(DataFrame.unionByName, parts).select("event_id", "event_name", "kind", "conditions", "tbl")


@query(
    "s21_report_summary",
    sql(
        """SELECT 'drive' AS report, 'histogram_fact' AS table_name, count(*) AS rows, count(DISTINCT container_id) AS recordings FROM fact
UNION ALL SELECT 'drive', 'histogram2d_fact', count(*), count(DISTINCT container_id) FROM fact2
UNION ALL SELECT 'drive', 'stats_aggregator_fact', 4 * count(*), count(DISTINCT container_id) FROM stat
UNION ALL SELECT 'drive', 'measurement_dimension', count(*), count(*) FROM cm
UNION ALL SELECT 'drive', 'histogram_dimension', 5, NULL""",
        *REPORT_CTES,
    ),
)
def _(d):
    wanted = ("histogram_fact", "histogram2d_fact", "stats_aggregator_fact", "measurement_dimension", "histogram_dimension")
    return tables_of(d)["report_summary"].where(F.col("table_name").isin(*wanted))

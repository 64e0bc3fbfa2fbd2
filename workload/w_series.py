"""Series algebra over the sample table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators.align import overlaps
from seriesloom.operators.runs import polyline
from seriesloom.operators.series import Intervals, PointsInTime
from seriesloom.plans.definitions import Event, Threshold
from seriesloom.plans.report import evaluate_event
from workload.model import DAY, HOUR
from workload.registry import query
from workload.sql import at_points, compare, edges, islands, meet, sql

IV = "SELECT container_id, tstart, tend FROM x"
PT = "SELECT container_id, t FROM x"
SERIES = "SELECT container_id, tstart, tend, value FROM x"


def rounded(df, *columns, digits=4, scale=1.0):
    return df.withColumns({c: F.round(F.col(c) / scale, digits) for c in columns})


# -- encoding and edges ----------------------------------------------------------------------------------------------
@query("w1_run_length_encoding", sql("SELECT container_id, channel_id, tstart, tend, value FROM levels"))
def _(d):
    return d.levels


@query("w4_rising_edges", sql(PT, edges("x", "l_click", "value > pv")))
def _(d):
    return d.level("click").rising_edges().frame


@query("w4_falling_edges", sql(PT, edges("x", "l_click", "value < pv")))
def _(d):
    return d.level("click").falling_edges().frame


@query("w5_change_points", sql(PT, edges("x", "l_click", "pv = 0 AND value = 1")))
def _(d):
    return d.level("click").change_points(0, 1).frame


W6 = {
    "from_gt": ("pv > 0 AND value = 0", lambda s: s.change_points_from_arbitrary_state_gt(0)),
    "from_lt": ("pv < 1 AND value = 1", lambda s: s.change_points_from_arbitrary_state_lt(1)),
    "to_gt": ("pv = 0 AND value > 0", lambda s: s.change_points_to_arbitrary_state_gt(0)),
    "to_lt": ("pv = 1 AND value < 1", lambda s: s.change_points_to_arbitrary_state_lt(1)),
}


@query(
    "w6_arbitrary_change_points",
    sql(
        " UNION ALL ".join(f"SELECT '{k}' AS kind, container_id, t FROM x_{k}" for k in W6),
        *[edges(f"x_{k}", "l_click", c) for k, (c, _) in W6.items()],
    ),
)
def _(d):
    s, out = d.level("click"), None
    for kind, (_, op) in W6.items():
        part = op(s).frame.select(F.lit(kind).alias("kind"), "container_id", "t")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "w7_cumulative_integral",
    sql(
        """SELECT container_id, tstart, tend, round(sum(coalesce((value + pv) / 2 * (tstart - ps), 0))
  OVER (PARTITION BY container_id ORDER BY tstart, tend ROWS UNBOUNDED PRECEDING) / 3.6e9, 4) AS value FROM x""",
        """x AS (SELECT *, lag(value) OVER w AS pv, lag(tstart) OVER w AS ps FROM s_click
  WINDOW w AS (PARTITION BY container_id ORDER BY tstart, tend))""",
    ),
)
def _(d):
    return rounded(d.signal("click").cumtrapz().frame, "value", scale=float(HOUR))


@query(
    "w7_cumulative_integral_restarting",
    sql(
        """SELECT container_id, tstart, tend, round(sum(CASE WHEN gap = 1 OR pv IS NULL THEN 0 ELSE (value + pv) / 2 * (tstart - ps) END)
  OVER (PARTITION BY container_id, part ORDER BY tstart, tend ROWS UNBOUNDED PRECEDING) / 3.6e9, 4) AS value FROM z""",
        meet("x", "s_click", "busy", "a.container_id AS container_id, s AS tstart, e AS tend, a.value AS value"),
        """y AS (SELECT *, lag(value) OVER w AS pv, lag(tstart) OVER w AS ps,
  CASE WHEN lag(tend) OVER w < tstart THEN 1 ELSE 0 END AS gap FROM x WINDOW w AS (PARTITION BY container_id ORDER BY tstart, tend))""",
        "z AS (SELECT *, sum(gap) OVER (PARTITION BY container_id ORDER BY tstart, tend ROWS UNBOUNDED PRECEDING) AS part FROM y)",
    ),
)
def _(d):
    s = d.signal("click").where(d.busy())
    return rounded(s.cumtrapz(cum_across_uncontinuous_intervals=False).frame, "value", scale=float(HOUR))


@query(
    "w8_difference",
    sql(
        """SELECT container_id, tstart, tend, round(coalesce(value - lag(value) OVER
  (PARTITION BY container_id ORDER BY tstart, tend), 0), 4) AS value FROM s_click"""
    ),
)
def _(d):
    return rounded(d.signal("click").diff().frame, "value")


@query(
    "w9_filter_by_distance",
    sql(
        "SELECT container_id, t FROM y WHERE p IS NULL OR t - p >= 86400000000",
        edges("x", "s_click", "value > pv"),
        "y AS (SELECT *, lag(t) OVER (PARTITION BY container_id ORDER BY t) AS p FROM x)",
    ),
)
def _(d):
    return d.signal("click").rising_edges().filter_by_distance(DAY).frame


@query(
    "w10_merge_overlaps",
    sql(IV, "raw AS (SELECT container_id, time - 7200000000 AS tstart, time + 3600000000 AS tend FROM bronze)", islands("x", "raw")),
)
def _(d):
    raw = d.samples.select(
        "container_id", (F.col("time") - 2 * HOUR).alias("tstart"), (F.col("time") + HOUR).alias("tend")
    )
    return Intervals(raw, d.grid).merge_overlaps().frame


@query(
    "w11_flipflop",
    sql(
        "SELECT container_id, min(t) AS tstart, nr AS tend FROM y WHERE nr IS NOT NULL GROUP BY container_id, nr",
        edges("st", "s_click", "value > pv"),
        edges("rs", "s_view", "value < pv"),
        """y AS (SELECT st.container_id, st.t, (SELECT min(rs.t) FROM rs WHERE rs.container_id = st.container_id AND rs.t > st.t) AS nr
  FROM st WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.container_id = st.container_id AND rs.t = st.t))""",
    ),
)
def _(d):
    return d.signal("click").rising_edges().flipflop(d.signal("view").falling_edges()).frame


@query(
    "w12_intervals_between_falling_edges",
    sql(
        "SELECT container_id, t AS tstart, n AS tend FROM (SELECT *, lead(t) OVER (PARTITION BY container_id ORDER BY t) AS n FROM x) WHERE n IS NOT NULL",
        "m AS (SELECT container_id, tstart, tend, value % 100 AS value FROM odo)",
        edges("x", "m", "value < pv"),
    ),
)
def _(d):
    return (d.odometer % 100).intervals_between_falling_edges().frame


@query(
    "w13_event_instances",
    sql("SELECT container_id, tstart, tend, row_number() OVER (PARTITION BY container_id ORDER BY tstart) AS event_number FROM hot"),
)
def _(d):
    return d.hot().instances().select("container_id", "tstart", "tend", "event_number")


@query(
    "w14_continuity",
    sql(
        "SELECT container_id, tstart, tend, value, sum(gap) OVER (PARTITION BY container_id ORDER BY tstart, tend ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM y",
        meet("x", "s_click", "busy", "a.container_id AS container_id, s AS tstart, e AS tend, a.value AS value"),
        "y AS (SELECT *, CASE WHEN lag(tend) OVER (PARTITION BY container_id ORDER BY tstart, tend) < tstart THEN 1 ELSE 0 END AS gap FROM x)",
    ),
)
def _(d):
    return d.signal("click").where(d.busy()).continuity()


# -- filters and comparisons -----------------------------------------------------------------------------------------
@query(
    "p17_where_intervals",
    sql(SERIES, meet("x", "s_click", "busy", "a.container_id AS container_id, s AS tstart, e AS tend, a.value AS value")),
)
def _(d):
    return d.signal("click").where(d.busy()).frame


@query("p18_where_points", sql("SELECT container_id, t, value FROM x", edges("p", "s_view", "value > pv"), at_points("x", "p", "s_click")))
def _(d):
    return d.signal("click").where(d.signal("view").rising_edges()).frame


P19 = {
    "gt": ("value > 1", lambda s: s > 1),
    "ge": ("value >= 1", lambda s: s >= 1),
    "lt": ("value < 1", lambda s: s < 1),
    "le": ("value <= 1", lambda s: s <= 1),
    "eq": ("value = 1", lambda s: s == 1),
    "ne": ("value <> 1", lambda s: s != 1),
}


@query(
    "p19_comparisons",
    sql(
        " UNION ALL ".join(f"SELECT '{k}' AS op, container_id, tstart, tend FROM x_{k}" for k in P19),
        *[compare(f"x_{k}", "l_click", c) for k, (c, _) in P19.items()],
    ),
)
def _(d):
    found = d.level("click").meeting({name: op for name, (_, op) in P19.items()})
    return found.withColumnRenamed("condition", "op")


@query(
    "p19_comparison_of_two_series",
    sql(
        IV,
        meet("y", "s_click", "s_view", "a.container_id AS container_id, s AS tstart, e AS tend, a.value > b.value AS value"),
        compare("x", "y", "value"),
    ),
)
def _(d):
    return (d.signal("click") > d.signal("view")).frame


# -- alignment -------------------------------------------------------------------------------------------------------
PAIR = "a.container_id AS container_id, s AS tstart, e AS tend, a.value AS a, b.value AS b"


@query(
    "j11_interval_overlap",
    sql(
        "SELECT * FROM x",
        meet("x", "s_click", "hot", "a.container_id AS container_id, s AS tstart, e AS tend, a.tstart AS run_start, b.tstart AS interval_start"),
    ),
)
def _(d):
    met = overlaps({"a": d.signal("click").frame, "b": d.hot().frame}, d.grid)
    return met.select(
        "container_id", "tstart", "tend", F.col("a.tstart").alias("run_start"), F.col("b.tstart").alias("interval_start")
    )


@query(
    "j12_as_of",
    sql(
        "SELECT container_id, t, value FROM x",
        "p AS (SELECT container_id, time AS t FROM bronze WHERE channel_name = 'error')",
        at_points("x", "p", "s_click"),
    ),
)
def _(d):
    points = d.channel_samples("error").select("container_id", F.col("time").alias("t"))
    return d.signal("click").where(PointsInTime(points, d.grid)).frame


@query("j13_synchronized", sql("SELECT container_id, tstart, tend, a, b FROM x", meet("x", "s_click", "s_view", PAIR)))
def _(d):
    return d.signal("click").aligned({"b": d.signal("view")}, own="a")


@query(
    "j14_synchronized_all",
    sql(
        """SELECT a.container_id, greatest(a.tstart, b.tstart, c.tstart) AS tstart, least(a.tend, b.tend, c.tend) AS tend,
  a.value AS a, b.value AS b, c.value AS c
FROM s_click a JOIN s_view b ON a.container_id = b.container_id AND a.tstart < b.tend AND b.tstart < a.tend
JOIN s_error c ON a.container_id = c.container_id AND greatest(a.tstart, b.tstart) < c.tend AND c.tstart < least(a.tend, b.tend)
WHERE a.tend > a.tstart AND b.tend > b.tstart AND c.tend > c.tstart"""
    ),
)
def _(d):
    return d.signal("click").aligned({"b": d.signal("view"), "c": d.signal("error")}, own="a")


J15 = {
    "add": ("a + b", lambda a, b: a + b),
    "sub": ("a - b", lambda a, b: a - b),
    "mul": ("a * b", lambda a, b: a * b),
    "div": ("a / b", lambda a, b: a / b),
}


@query(
    "j15_arithmetic",
    sql(
        " UNION ALL ".join(
            f"SELECT '{k}' AS op, container_id, tstart, tend, round({e}, 4) AS value FROM x" for k, (e, _) in J15.items()
        ),
        meet("x", "s_click", "s_view", PAIR),
    ),
)
def _(d):
    a, b, out = d.signal("click"), d.signal("view"), None
    for name, (_, op) in J15.items():
        part = op(a, b).frame.withColumn("op", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "value").select("op", "container_id", "tstart", "tend", "value")


@query(
    "j16_matching_points",
    sql(
        "SELECT container_id, t FROM p SEMI JOIN q USING (container_id, t)",
        edges("p", "s_click", "value > pv"),
        edges("q", "l_click", "value > pv"),
    ),
)
def _(d):
    return (d.signal("click").rising_edges() & d.level("click").rising_edges()).frame


# -- scalars ---------------------------------------------------------------------------------------------------------
@query(
    "a8_series_scalars",
    sql(
        """SELECT container_id, max(value) AS max, min(value) AS min,
  round(coalesce(sum(value * (tend - tstart)) / nullif(sum(tend - tstart), 0), 'nan'::DOUBLE), 4) AS mean,
  round(sum(value * (tend - tstart)) / 3.6e9, 4) AS sum FROM s_click GROUP BY container_id"""
    ),
)
def _(d):
    s = d.signal("click").scalars()
    return s.select(
        "container_id", "max", "min", F.round("mean", 4).alias("mean"), F.round(F.col("sum") / float(HOUR), 4).alias("sum")
    )


@query(
    "a9_series_metadata",
    sql(
        """SELECT container_id, count(*) AS sample_count,
  round(count(*) / nullif((max(tend) - min(tstart)) / 1e6, 0) * 3600, 6) AS sample_rate,
  round(sum(tend - tstart) / 1e3, 3) AS duration_ms, min(tstart) AS start_time, max(tend) AS end_time, 0.0::DOUBLE AS nan_ratio
FROM s_click GROUP BY container_id"""
    ),
)
def _(d):
    m = d.signal("click").metadata()
    return m.withColumn("sample_rate", F.round(F.col("sample_rate") * 3600, 6)).withColumn(
        "duration_ms", F.round("duration_ms", 3)
    )


@query(
    "a10_within_intervals",
    sql(
        """SELECT container_id, tstart, tend, max(v) AS max, min(v) AS min, round(sum(v * w) / sum(w), 4) AS mean
FROM x GROUP BY container_id, tstart, tend""",
        meet("x", "s_click", "busy", "a.container_id AS container_id, b.tstart AS tstart, b.tend AS tend, a.value AS v, e - s AS w"),
    ),
)
def _(d):
    return d.signal("click").within_intervals(d.busy()).withColumn("mean", F.round("mean", 4))


@query(
    "a11_interval_summary",
    sql(
        """SELECT container_id, count(*) AS n_intervals, min(tstart) AS start_time, max(tend) AS end_time,
  sum(tend - tstart)::BIGINT AS duration, round(sum(tend - tstart) / 1e3, 3) AS duration_ms FROM hot GROUP BY container_id"""
    ),
)
def _(d):
    return d.hot().summary().withColumn("duration_ms", F.round("duration_ms", 3))


@query(
    "a12_pit_scalars",
    sql(
        "SELECT container_id, max(value) AS max, min(value) AS min FROM x GROUP BY container_id",
        edges("p", "s_view", "value > pv"),
        at_points("x", "p", "s_click"),
    ),
)
def _(d):
    pits = d.signal("click").where(d.signal("view").rising_edges())
    top = pits.max().withColumnRenamed("value", "max")
    return top.join(pits.min().withColumnRenamed("value", "min"), "container_id")


@query(
    "a13_integral",
    sql(
        """SELECT container_id, round(sum(coalesce((value + pv) / 2 * (tstart - ps), 0)) / 3.6e9, 4) AS value FROM (
  SELECT *, lag(value) OVER w AS pv, lag(tstart) OVER w AS ps FROM s_click
  WINDOW w AS (PARTITION BY container_id ORDER BY tstart, tend)) GROUP BY container_id"""
    ),
)
def _(d):
    return rounded(d.signal("click").trapz(), "value", scale=float(HOUR))


# -- sets and transforms ---------------------------------------------------------------------------------------------
@query("u3_interval_and", sql(IV, meet("x", "hot", "busy", "a.container_id AS container_id, s AS tstart, e AS tend")))
def _(d):
    return (d.hot() & d.busy()).frame


@query("u4_interval_or", sql(IV, islands("x", "(SELECT * FROM hot UNION ALL SELECT * FROM busy)")))
def _(d):
    return (d.hot() | d.busy()).frame


@query(
    "u5_point_difference",
    sql(
        "SELECT container_id, t FROM p ANTI JOIN q USING (container_id, t)",
        edges("p", "s_click", "value > pv"),
        edges("q", "l_click", "value > pv"),
    ),
)
def _(d):
    return d.signal("click").rising_edges().filter(d.level("click").rising_edges(), inverse=True).frame


def _widened(left: int, right: int, name: str) -> str:
    return islands(name, f"(SELECT container_id, tstart - {left} AS tstart, tend + {right} AS tend FROM hot)")


@query(
    "i1_expand",
    sql(
        "SELECT 'both' AS side, * FROM x1 UNION ALL SELECT 'left', * FROM x2 UNION ALL SELECT 'right', * FROM x3",
        _widened(HOUR, HOUR, "x1"),
        _widened(2 * HOUR, 0, "x2"),
        _widened(0, 3 * HOUR, "x3"),
    ),
)
def _(d):
    iv = d.hot()
    parts = {"both": iv.expand(HOUR), "left": iv.expand_left(2 * HOUR), "right": iv.expand_right(3 * HOUR)}
    return _labelled("side", parts)


def _labelled(column, parts):
    out = None
    for name, s in parts.items():
        part = s.frame.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _shrunk(left: int, right: int) -> str:
    return f"container_id, tstart + {left} AS tstart, tend - {right} AS tend FROM hot WHERE tend - tstart > {left + right}"


@query(
    "i2_shrink",
    sql(
        f"SELECT 'both' AS side, {_shrunk(12 * HOUR, 12 * HOUR)} UNION ALL SELECT 'left', {_shrunk(DAY, 0)} "
        f"UNION ALL SELECT 'right', {_shrunk(0, DAY)}"
    ),
)
def _(d):
    iv = d.hot()
    return _labelled(
        "side", {"both": iv.shrink(12 * HOUR), "left": iv.shrink_left(DAY), "right": iv.shrink_right(DAY)}
    )


@query(
    "i3_delay",
    sql(
        f"SELECT container_id, tstart + {HOUR} AS tstart, tend + {HOUR} AS tend FROM hot UNION ALL SELECT container_id, t - {HOUR}, t - {HOUR} FROM p",
        edges("p", "s_click", "value > pv"),
    ),
)
def _(d):
    points = d.signal("click").rising_edges().delay(-HOUR).frame
    return d.hot().delay(HOUR).frame.unionByName(
        points.select("container_id", F.col("t").alias("tstart"), F.col("t").alias("tend"))
    )


HIT = "EXISTS (SELECT 1 FROM busy b WHERE b.container_id = h.container_id AND b.tstart < h.tend AND h.tstart < b.tend)"
HIT_POINT = "EXISTS (SELECT 1 FROM p WHERE p.container_id = h.container_id AND p.t >= h.tstart AND p.t < h.tend)"


@query(
    "i4_filter",
    sql(
        f"""SELECT 'by intervals' AS kind, * FROM hot h WHERE {HIT}
UNION ALL SELECT 'not by intervals', * FROM hot h WHERE NOT {HIT}
UNION ALL SELECT 'by points', * FROM hot h WHERE {HIT_POINT}""",
        edges("p", "s_error", "value > pv"),
    ),
)
def _(d):
    hot, busy = d.hot(), d.busy()
    return _labelled(
        "kind",
        {
            "by intervals": hot.filter(busy),
            "not by intervals": hot.filter(busy, inverse=True),
            "by points": hot.filter(d.signal("error").rising_edges()),
        },
    )


@query(
    "i5_filter_first_intersection",
    sql(
        """SELECT DISTINCT container_id, tstart, tend FROM (SELECT h.*, row_number() OVER (PARTITION BY b.container_id, b.tstart ORDER BY h.tstart) AS rn
  FROM hot h JOIN busy b ON b.container_id = h.container_id AND b.tstart < h.tend AND h.tstart < b.tend) WHERE rn = 1"""
    ),
)
def _(d):
    return d.hot().filter_first_intersection(d.busy()).frame


@query(
    "i5_first_point_in_interval",
    sql(
        """SELECT p.container_id, min(p.t) AS t FROM p JOIN busy b ON b.container_id = p.container_id AND p.t >= b.tstart AND p.t < b.tend
GROUP BY p.container_id, b.tstart""",
        edges("p", "s_click", "value > pv"),
    ),
)
def _(d):
    return d.signal("click").rising_edges().filter_first_intersection(d.busy()).frame


@query(
    "i6_filter_intersection_sides",
    sql(
        "SELECT 'left' AS side, container_id, s AS tstart, ae AS tend FROM x UNION SELECT 'right', container_id, ab, e FROM x",
        meet("x", "hot", "busy", "a.container_id AS container_id, s, e, a.tstart AS ab, a.tend AS ae"),
    ),
)
def _(d):
    hot, busy = d.hot(), d.busy()
    return _labelled(
        "side", {"left": hot.filter_intersection_left(busy), "right": hot.filter_intersection_right(busy)}
    )


@query(
    "i7_interval_accessors",
    sql(
        """SELECT 'start' AS kind, container_id, tstart AS t FROM hot UNION ALL SELECT 'end', container_id, tend FROM hot
UNION ALL SELECT 'duration', container_id, tend - tstart FROM hot"""
    ),
)
def _(d):
    iv = d.hot()
    points = _labelled("kind", {"start": iv.start_points(), "end": iv.end_points()})
    lengths = iv.durations().select("container_id", F.col("duration").alias("t"), F.lit("duration").alias("kind"))
    return points.unionByName(lengths)


def _around(left: int, right: int, name: str) -> str:
    return islands(name, f"(SELECT container_id, t - {left} AS tstart, t + {right} AS tend FROM p)")


@query(
    "i8_expand_points",
    sql(
        "SELECT 'both' AS side, * FROM x1 UNION ALL SELECT 'left', * FROM x2 UNION ALL SELECT 'right', * FROM x3",
        edges("p", "s_click", "value > pv"),
        _around(DAY, DAY, "x1"),
        _around(2 * DAY, 0, "x2"),
        _around(0, HOUR, "x3"),
    ),
)
def _(d):
    p = d.signal("click").rising_edges()
    return _labelled(
        "side", {"both": p.expand(DAY), "left": p.expand_left(2 * DAY), "right": p.expand_right(HOUR)}
    )


@query("i9_empty_series", sql("SELECT container_id, tstart, tend FROM hot"))
def _(d):
    return (d.hot() | Intervals.empty(d.spark, d.grid)).frame


HOT_OR_BUSY = (Threshold("click", ">", 40), Threshold("view", ">", 30))
EVENTS = {
    "interval_and": Event("e", "interval", HOT_OR_BUSY),
    "interval_or": Event("e", "interval", HOT_OR_BUSY, logic="OR"),
    "rising": Event("e", "rising_edges", HOT_OR_BUSY),
    "falling": Event("e", "falling_edges", HOT_OR_BUSY, logic="OR"),
    "change": Event("e", "change_points", signal="level", from_state=0, to_state=1),
    "periodic": Event("e", "periodic_distance", signal="odometer", step=100),
}


@query(
    "i10_event_kinds",
    sql(
        """SELECT 'interval_and' AS kind, container_id, tstart, tend FROM xa UNION ALL SELECT 'interval_or', * FROM xo
UNION ALL SELECT 'rising', container_id, tstart, tstart FROM xa UNION ALL SELECT 'falling', container_id, tend, tend FROM xo
UNION ALL SELECT 'change', container_id, t, t FROM xc
UNION ALL SELECT 'periodic', container_id, t, n FROM (SELECT *, lead(t) OVER (PARTITION BY container_id ORDER BY t) AS n FROM xp) WHERE n IS NOT NULL""",
        meet("xa", "hot", "busy", "a.container_id AS container_id, s AS tstart, e AS tend"),
        islands("xo", "(SELECT * FROM hot UNION ALL SELECT * FROM busy)"),
        edges("xc", "l_click", "pv = 0 AND value = 1"),
        "m AS (SELECT container_id, tstart, tend, value % 100 AS value FROM odo)",
        edges("xp", "m", "value < pv"),
    ),
)
def _(d):
    signals = {
        "click": d.signal("click"),
        "view": d.signal("view"),
        "level": d.level("click"),
        "odometer": d.odometer,
    }
    out = None
    for name, event in EVENTS.items():
        f = evaluate_event(event, signals).frame
        if "t" in f.columns:
            f = f.select("container_id", F.col("t").alias("tstart"), F.col("t").alias("tend"))
        part = f.withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "x5_series_scalar_operations",
    sql(
        """SELECT container_id, tstart, tend, round(abs(10 - value) * 2 + exp(-value / 100), 4) AS value,
  round((value * 3 - 7) / 4 % 5 + CASE WHEN (value * 3 - 7) / 4 % 5 < 0 THEN 5 ELSE 0 END, 4) AS rest FROM s_click"""
    ),
)
def _(d):
    s = d.signal("click")
    first = (10 - s).abs() * 2
    second = (s / -100).exp()
    rest = ((s * 3 - 7) / 4) % 5
    keys = ["container_id", "tstart", "tend"]
    rows = first.frame.join(second.frame.withColumnRenamed("value", "e"), keys)
    rows = rows.join(rest.frame.withColumnRenamed("value", "rest"), keys)
    return rows.select(*keys, F.round(F.col("value") + F.col("e"), 4).alias("value"), F.round("rest", 4).alias("rest"))


@query(
    "k6_step_polyline",
    sql(
        """SELECT container_id, channel_id, tstart AS t, value FROM runs
UNION ALL SELECT container_id, channel_id, tend, value FROM runs WHERE tend <> tstart"""
    ),
)
def _(d):
    return polyline(d.runs).select("container_id", "channel_id", "t", "value")


@query(
    "k9_resample",
    sql(
        f"""SELECT container_id, t AS tstart, least(t + {6 * HOUR}, hi) AS tend, value FROM x""",
        "span AS (SELECT container_id, min(tstart) AS lo, max(tend) AS hi FROM s_click GROUP BY container_id)",
        f"p AS (SELECT container_id, hi, unnest(range(lo, hi + 1, {6 * HOUR})) AS t FROM span)",
        at_points("x", "p", "s_click", columns="p.container_id, p.t, p.hi, r.value"),
    ),
)
def _(d):
    return d.signal("click").resample(6 * HOUR).frame

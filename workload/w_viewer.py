"""Chart data of single channels and lists of channels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.operators.grid import measure_grid
from seriesloom.operators.viewer import (
    downsample,
    evenly_spaced,
    normalise,
    point_counts,
    window_points,
    window_runs,
)
from seriesloom.plans.charts import assign_axes
from workload.model import TICKS
from workload.registry import query
from workload.sql import sql

#: 2024-01-10 and 2024-01-20 in ticks.
LO, HI = 1704844800000000, 1705708800000000


def points_of(d):
    return d.samples.select("container_id", "channel_id", F.col("time").alias("t"), "value")


@query("p11_point_window", sql(f"SELECT container_id, channel_id, time AS t, value FROM bronze WHERE time BETWEEN {LO} AND {HI}"))
def _(d):
    return window_points(points_of(d), LO, HI)


@query("p12_run_window", sql(f"SELECT container_id, channel_id, tstart, tend, value FROM levels WHERE tstart <= {HI} AND tend >= {LO}"))
def _(d):
    return window_runs(d.levels, LO, HI)


@query("s19_fetch_channel", sql("SELECT tstart, tend, value FROM runs WHERE container_id = 3 AND channel_id = 5"))
def _(d):
    return d.catalog().fetch_channel(3, 5)


#: The plain method: one bucket after another, each choosing beside the point chosen before and the mean of the next bucket.
LTTB = sql(
    "SELECT channel_name, p.t AS t, p.v AS value FROM pick UNION ALL SELECT channel_name, t, v FROM b WHERE i = n - 1",
    """numbered AS (SELECT channel_name, time AS t, value AS v, time - min(time) OVER w AS dt, row_number() OVER (w ORDER BY time, value) - 1 AS i,
  count(*) OVER w AS n FROM bronze WINDOW w AS (PARTITION BY channel_name))""",
    "b AS (SELECT *, CASE WHEN i = 0 THEN -1 WHEN i = n - 1 THEN 98 ELSE (i * 98 - 1) // (n - 2) END AS k FROM numbered)",
    "m AS (SELECT channel_name, k, avg(dt) AS t, avg(v) AS v FROM b GROUP BY channel_name, k)",
    """pick AS (SELECT channel_name, k, {'t': t, 'dt': dt, 'v': v} AS p FROM b WHERE i = 0
  UNION ALL SELECT a.channel_name, a.k + 1, arg_max({'t': b.t, 'dt': b.dt, 'v': b.v},
    abs((a.p.dt - m.t) * (b.v - a.p.v) - (a.p.dt - b.dt) * (m.v - a.p.v)))
  FROM pick a JOIN b ON b.channel_name = a.channel_name AND b.k = a.k + 1 JOIN m ON m.channel_name = a.channel_name AND m.k = a.k + 2
  WHERE a.k + 1 < 98 GROUP BY a.channel_name, a.k)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("k4_downsample", LTTB)
def _(d):
    """Whole channels over all recordings: enough points for the sampling to have something to do."""
    by_channel = d.samples.select("channel_name", F.col("time").alias("t"), "value")
    if "channel_grid" not in d.memo:  # a channel of all recordings is longer than a recording
        d.memo["channel_grid"] = measure_grid(by_channel, TICKS, key="channel_name", time="t")
    return downsample(by_channel, 100, d.memo["channel_grid"], keys=("channel_name",))


@query(
    "k5_evenly_spaced",
    sql(
        """SELECT container_id, channel_id, time AS t, value FROM (
  SELECT *, row_number() OVER (PARTITION BY container_id, channel_id ORDER BY time) - 1 AS i,
    count(*) OVER (PARTITION BY container_id, channel_id) AS n FROM bronze)
WHERE n <= 5 OR i = 0 OR i = round_even((n - 1) / 4.0, 0) OR i = round_even((n - 1) * 2 / 4.0, 0)
  OR i = round_even((n - 1) * 3 / 4.0, 0) OR i = n - 1"""
    ),
)
def _(d):
    return evenly_spaced(points_of(d), 5, d.grid)


@query(
    "k7_normalise",
    sql(
        """SELECT container_id, channel_id, time / 1e6 AS t, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS v,
  round(value, 6) AS v_raw FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM bronze
  WINDOW w AS (PARTITION BY container_id, channel_id))"""
    ),
)
def _(d):
    return normalise(points_of(d), d.grid)


@query(
    "k8_point_counts",
    sql(
        f"""SELECT container_id, channel_id, count(*) AS total_points, count(*) FILTER (time BETWEEN {LO} AND {HI}) AS window_points
FROM bronze GROUP BY container_id, channel_id"""
    ),
)
def _(d):
    return point_counts(points_of(d), LO, HI)


@query(
    "v3_axis_assignment",
    sql(
        """SELECT channel_id, unit, CASE WHEN r = 4 THEN 'right' ELSE 'left' END AS axis
FROM (SELECT channel_id, unit FROM g) JOIN (SELECT unit, row_number() OVER (ORDER BY avg((lo + hi) / 2)) AS r FROM g GROUP BY unit) USING (unit)""",
        "g AS (SELECT channel_id, min(unit) AS unit, min(min) AS lo, max(max) AS hi FROM chm GROUP BY channel_id)",
    ),
)
def _(d):
    signals = d.channel_metrics.groupBy("channel_id").agg(
        F.min("unit").alias("unit"), F.min("min").alias("min_value"), F.max("max").alias("max_value")
    )
    return assign_axes(signals)


@query("w2_channel_ordinal", sql("SELECT container_id, channel_name, row_number() OVER (PARTITION BY container_id ORDER BY channel_name) AS n FROM chm"))
def _(d):
    rows = d.samples.select("container_id", "channel_name").distinct()
    order = Window.partitionBy("container_id").orderBy("channel_name")
    return rows.withColumn("n", F.row_number().over(order).cast("long"))

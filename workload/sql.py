"""Building blocks of the check SQL: the model of the tables, and the plain ways to say intervals and joins."""

from __future__ import annotations

from collections.abc import Sequence


def rle(name: str, value: str) -> str:
    """Runs of equal neighbouring values per recording and channel."""
    return f"""{name} AS (
  SELECT container_id, channel_id, channel_name, min(time) AS tstart, max(next_time) AS tend, any_value(v) AS value
  FROM (SELECT *, sum(chg) OVER (PARTITION BY container_id, channel_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS rid
    FROM (SELECT *, coalesce(lead(time) OVER w, time) AS next_time,
            CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS chg
      FROM (SELECT *, {value} AS v FROM bronze)
      WINDOW w AS (PARTITION BY container_id, channel_id ORDER BY time)))
  GROUP BY container_id, channel_id, channel_name, rid)"""


def _channel(name: str, source: str, channel: str) -> str:
    return f"{name} AS (SELECT container_id, tstart, tend, value FROM {source} WHERE channel_name = '{channel}')"


def islands(name: str, source: str) -> str:
    """Union of overlapping and touching intervals."""
    return f"""{name} AS (
  SELECT container_id, min(tstart) AS tstart, max(tend) AS tend
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY container_id ORDER BY tstart, tend ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT container_id, tstart, tend, CASE WHEN tstart > max(tend) OVER (PARTITION BY container_id
            ORDER BY tstart, tend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
      FROM {source} WHERE tend > tstart))
  GROUP BY container_id, island)"""


def compare(name: str, series: str, condition: str) -> str:
    """Merged intervals where a condition on ``value`` holds."""
    return islands(name, f"(SELECT * FROM {series} WHERE {condition})")


def meet(name: str, a: str, b: str, columns: str) -> str:
    """Overlaps of two sets of runs as a range join; columns may use a, b, s (start) and e (end) of the overlap."""
    return f"""{name} AS (
  SELECT {columns} FROM (SELECT a, b, greatest(a.tstart, b.tstart) AS s, least(a.tend, b.tend) AS e
    FROM {a} a JOIN {b} b ON a.container_id = b.container_id AND a.tstart < b.tend AND b.tstart < a.tend
    WHERE a.tend > a.tstart AND b.tend > b.tstart))"""


def at_points(name: str, points: str, runs: str, closed: bool = True, columns: str = "p.container_id, p.t, r.value") -> str:
    """The run holding each point."""
    op = "<=" if closed else "<"
    return f"""{name} AS (
  SELECT {columns} FROM {points} p ASOF JOIN {runs} r ON p.container_id = r.container_id AND p.t >= r.tstart
  WHERE p.t {op} r.tend)"""


def edges(name: str, series: str, condition: str) -> str:
    """Points where a condition on ``value`` and the value before (``pv``) holds."""
    return f"""{name} AS (
  SELECT container_id, tstart AS t FROM (SELECT *, lag(value) OVER (PARTITION BY container_id ORDER BY tstart, tend) AS pv
    FROM {series}) WHERE {condition})"""


def bin_case(value: str, bins: Sequence[float]) -> str:
    """Bin number by a chain of comparisons; NULL outside."""
    steps = " ".join(f"WHEN {value} < {e} THEN {i}" for i, e in enumerate(bins[1:-1]))
    inner = f"CASE {steps} ELSE {len(bins) - 2} END" if steps else "0"
    return f"CASE WHEN {value} < {bins[0]} OR {value} > {bins[-1]} OR {value} IS NULL THEN NULL ELSE {inner} END"


def bin_values(bins: Sequence[float], prefix: str = "") -> str:
    rows = ", ".join(
        f"({i}, {float(a)}::DOUBLE, {float(b)}::DOUBLE, '{a} - {b}')" for i, (a, b) in enumerate(zip(bins, bins[1:]))
    )
    p = prefix
    return f"(VALUES {rows}) AS bins{p.strip('_')}({p}bin_id, {p}lower_bound, {p}upper_bound, {p}bin_name)"


def histogram(name: str, rows: str, bins: Sequence[float]) -> str:
    """Rows (container_id, v, w) to one fact row per recording and bin."""
    return f"""{name} AS (
  SELECT c.container_id, bin_id, lower_bound, upper_bound, bin_name, coalesce(h.w, 0)::DOUBLE AS hist_value
  FROM (SELECT DISTINCT container_id FROM {rows}) c CROSS JOIN {bin_values(bins)}
  LEFT JOIN (SELECT container_id, {bin_case('v', bins)} AS b, sum(w) AS w FROM {rows} GROUP BY ALL) h
    ON h.container_id = c.container_id AND h.b = bin_id)"""


BASE = ",\n".join(
    [
        """bronze AS (SELECT user_id AS container_id,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS channel_id,
  event_type AS channel_name,
  CASE event_type WHEN 'click' THEN 'rpm' WHEN 'error' THEN '°C' WHEN 'purchase' THEN 'km' WHEN 'signup' THEN 'rpm' ELSE 'km/h' END AS unit,
  'veh_' || (user_id % 7) AS vehicle_key, epoch_us(ts) AS time, value, props FROM events)""",
        rle("runs", "value"),
        rle("levels", "floor(value / 50)"),
        *[_channel(f"s_{c}", "runs", c) for c in ("click", "error", "purchase", "signup", "view")],
        *[_channel(f"l_{c}", "levels", c) for c in ("click", "error", "purchase", "signup", "view")],
        """odo AS (SELECT container_id, tstart, tend,
  sum(floor(value)) OVER (PARTITION BY container_id ORDER BY tstart, tend ROWS UNBOUNDED PRECEDING) AS value FROM s_purchase)""",
        compare("hot", "s_click", "value > 40"),
        compare("busy", "s_view", "value > 30"),
        """chm AS (SELECT container_id, channel_id, min(channel_name) AS channel_name, min(unit) AS unit,
  count(*)::INTEGER AS sample_count, min(value) AS min, max(value) AS max, avg(value) AS mean,
  min(time) AS begin_ticks, max(time) AS end_ticks, max(time) - min(time) AS duration_ticks,
  CASE WHEN max(time) > min(time) THEN count(*) / ((max(time) - min(time)) / 1e6) END AS sample_rate
  FROM bronze GROUP BY container_id, channel_id)""",
        """cm AS (SELECT container_id, min(vehicle_key) AS vehicle_key, min(time) AS lo, max(time) AS hi,
  count(DISTINCT channel_id)::INTEGER AS num_channels FROM bronze GROUP BY container_id)""",
        """aliases AS (SELECT DISTINCT channel_name || '_' || vehicle_key AS channel_alias_name, channel_name, unit,
  'about ' || channel_name AS description FROM bronze)""",
        """ledger AS (SELECT container_id, 'run_' || (container_id % 5) AS run_id,
  'rec/' || min(vehicle_key) || '/' || container_id || '.dat' AS filename,
  CASE container_id % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' ELSE 'unprocessed' END AS status,
  1706745600000000 + (container_id % 5) * 3600000000 AS load_us FROM bronze GROUP BY container_id)""",
    ]
)


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + select

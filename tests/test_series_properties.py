"""The series algebra against plain Python on many random recordings at once."""

from __future__ import annotations

import math
import random

import pytest

from seriesloom.operators.grid import TimeGrid
from seriesloom.operators.series import Intervals, PitSeries, PointsInTime, SampleSeries

CASES = 120


def random_runs(rng):
    """Disjoint runs with gaps, touching neighbours and zero-length last runs."""
    t, out = rng.randint(-30, 30), []
    for _ in range(rng.randint(0, 9)):
        t += rng.choice([0, 0, 0, 3, 11])
        length = rng.choice([1, 2, 5, 9, 25])
        out.append((t, t + length, float(rng.randint(0, 3))))
        t += length
    if out and rng.random() < 0.4:
        out.append((t, t, float(rng.randint(0, 3))))
    return out


def random_intervals(rng):
    out = []
    for _ in range(rng.randint(0, 7)):
        start = rng.randint(-40, 90)
        out.append((start, start + rng.choice([0, 1, 4, 10, 30])))
    return out


def random_points(rng):
    return sorted(rng.sample(range(-40, 90), rng.randint(0, 8)))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    return {
        i: {
            "a": random_runs(rng),
            "b": random_runs(rng),
            "iv": random_intervals(rng),
            "jv": random_intervals(rng),
            "p": random_points(rng),
            "q": random_points(rng),
        }
        for i in range(CASES)
    }


def frame(spark, cases, name, schema):
    rows = [(i, *(r if isinstance(r, tuple) else (r,))) for i, c in cases.items() for r in c[name]]
    return spark.createDataFrame(rows, f"container_id bigint, {schema}")


@pytest.fixture
def make(spark, cases, grid):
    def build(name):
        if name in "ab":
            return SampleSeries(frame(spark, cases, name, "tstart bigint, tend bigint, value double"), grid)
        if name in ("iv", "jv"):
            return Intervals(frame(spark, cases, name, "tstart bigint, tend bigint"), grid)
        return PointsInTime(frame(spark, cases, name, "t bigint"), grid)

    return build


def check(got, want):
    """Rows of a series against a dict of lists per recording."""
    have = {}
    for row in got.frame.collect():
        have.setdefault(row[0], []).append(tuple(row)[1:])
    for i, rows in want.items():
        expected = sorted(r if isinstance(r, tuple) else (r,) for r in rows)
        found = sorted(have.get(i, []))
        assert len(found) == len(expected), (i, found, expected)
        for f, e in zip(found, expected):
            assert all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(f, e)), (i, f, e)


# -- the plain models ------------------------------------------------------------------------------------------------
def merge(ivs):
    out = []
    for s, e in sorted(x for x in ivs if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def cross(a, b):
    """Overlaps of two lists of runs: (start, end, left, right)."""
    out = []
    for x in a:
        for y in b:
            s, e = max(x[0], y[0]), min(x[1], y[1])
            if s < e and x[0] < x[1] and y[0] < y[1]:
                out.append((s, e, x, y))
    return out


def value_at(runs, t):
    before = [r for r in runs if r[0] <= t]
    if not before or before[-1][1] < t:
        return None
    return before[-1][2]


def test_merge(make, cases):
    check(make("iv").merge_overlaps(), {i: merge(c["iv"]) for i, c in cases.items()})


def test_and_or(make, cases):
    a, b = make("iv"), make("jv")
    check(a & b, {i: [x[:2] for x in cross(merge(c["iv"]), merge(c["jv"]))] for i, c in cases.items()})
    check(a | b, {i: merge(c["iv"] + c["jv"]) for i, c in cases.items()})


@pytest.mark.parametrize("left,right", [(4, 4), (9, 0), (0, 13)])
def test_expand(make, cases, left, right):
    iv = make("iv")
    got = iv.expand(left) if left == right else iv.expand_left(left) if left else iv.expand_right(right)
    check(got, {i: merge([(s - left, e + right) for s, e in c["iv"]]) for i, c in cases.items()})


def test_shrink_and_delay(make, cases):
    iv = make("iv").merge_overlaps()
    check(iv.shrink(2), {i: [(s + 2, e - 2) for s, e in merge(c["iv"]) if s + 2 < e - 2] for i, c in cases.items()})
    check(iv.delay(-50), {i: [(s - 50, e - 50) for s, e in merge(c["iv"])] for i, c in cases.items()})


def test_filter_intervals(make, cases):
    a, b = make("iv"), make("jv")

    def hit(x, others):
        return any(max(x[0], y[0]) < min(x[1], y[1]) for y in others)

    check(a.filter(b), {i: [x for x in merge(c["iv"]) if hit(x, merge(c["jv"]))] for i, c in cases.items()})
    check(
        a.filter(b, inverse=True),
        {i: [x for x in merge(c["iv"]) if not hit(x, merge(c["jv"]))] for i, c in cases.items()},
    )
    check(
        a.filter(make("p")),
        {i: [x for x in merge(c["iv"]) if any(x[0] <= t < x[1] for t in c["p"])] for i, c in cases.items()},
    )


def test_intersections(make, cases):
    a, b = make("iv"), make("jv")
    pairs = {i: cross(merge(c["iv"]), merge(c["jv"])) for i, c in cases.items()}
    firsts = {}
    for i, met in pairs.items():
        first = {}
        for s, e, x, y in sorted(met):
            first.setdefault(y, x)
        firsts[i] = set(first.values())
    check(a.filter_first_intersection(b), firsts)
    check(a.filter_intersection_left(b), {i: {(s, x[1]) for s, e, x, y in m} for i, m in pairs.items()})
    check(a.filter_intersection_right(b), {i: {(x[0], e) for s, e, x, y in m} for i, m in pairs.items()})
    check(
        make("p").filter_first_intersection(b),
        {
            i: [min(t for t in c["p"] if s <= t < e) for s, e in merge(c["jv"]) if any(s <= t < e for t in c["p"])]
            for i, c in cases.items()
        },
    )


def test_points(make, cases):
    p, q = make("p"), make("q")
    check(p & q, {i: set(c["p"]) & set(c["q"]) for i, c in cases.items()})
    check(p.filter(q, inverse=True), {i: set(c["p"]) - set(c["q"]) for i, c in cases.items()})
    check(p.expand(5), {i: merge([(t - 5, t + 5) for t in c["p"]]) for i, c in cases.items()})
    check(
        p.filter_by_distance(10),
        {i: [t for k, t in enumerate(c["p"]) if k == 0 or t - c["p"][k - 1] >= 10] for i, c in cases.items()},
    )
    check(p.between_consecutive(), {i: list(zip(c["p"], c["p"][1:])) for i, c in cases.items()})


def latch(sets, resets):
    out, opened = [], None
    for t in sorted({*sets, *resets}):
        if t in resets:
            if opened is not None:
                out.append((opened, t))
            opened = None
        elif opened is None:
            opened = t
    return out


def test_flipflop(make, cases):
    check(make("p").flipflop(make("q")), {i: latch(c["p"], c["q"]) for i, c in cases.items()})


def test_where(make, cases):
    a = make("a")
    check(
        a.where(make("iv")),
        {i: [(s, e, x[2]) for s, e, x, _ in cross(c["a"], merge(c["iv"]))] for i, c in cases.items()},
    )
    check(
        a.where(make("p")),
        {i: [(t, value_at(c["a"], t)) for t in c["p"] if value_at(c["a"], t) is not None] for i, c in cases.items()},
    )


def test_arithmetic_and_comparison(make, cases):
    a, b = make("a"), make("b")
    check(a + b, {i: [(s, e, x[2] + y[2]) for s, e, x, y in cross(c["a"], c["b"])] for i, c in cases.items()})
    check(
        a > b, {i: merge([(s, e) for s, e, x, y in cross(c["a"], c["b"]) if x[2] > y[2]]) for i, c in cases.items()}
    )
    check(a >= 2, {i: merge([x[:2] for x in c["a"] if x[2] >= 2]) for i, c in cases.items()})


def test_three_series(make, cases):
    a, b = make("a"), make("b")
    got = a.synchronized_all([b, a * 2])
    want = {i: cross(c["a"], c["b"]) for i, c in cases.items()}
    check(got[0], {i: [(s, e, x[2]) for s, e, x, y in m] for i, m in want.items()})
    check(got[1], {i: [(s, e, y[2]) for s, e, x, y in m] for i, m in want.items()})
    check(got[2], {i: [(s, e, 2 * x[2]) for s, e, x, y in m] for i, m in want.items()})


def neighbours(runs):
    return list(zip(runs, runs[1:]))


def test_edges(make, cases):
    a = make("a")
    tests = {
        "rise": (a.rising_edges(), lambda p, v: v > p),
        "fall": (a.falling_edges(), lambda p, v: v < p),
        "change": (a.change_points(1, 2), lambda p, v: (p, v) == (1, 2)),
        "from_gt": (a.change_points_from_arbitrary_state_gt(1), lambda p, v: p > 1 and v == 1),
        "from_lt": (a.change_points_from_arbitrary_state_lt(1), lambda p, v: p < 1 and v == 1),
        "to_gt": (a.change_points_to_arbitrary_state_gt(1), lambda p, v: p == 1 and v > 1),
        "to_lt": (a.change_points_to_arbitrary_state_lt(1), lambda p, v: p == 1 and v < 1),
    }
    for got, hit in tests.values():
        check(got, {i: [y[0] for x, y in neighbours(c["a"]) if hit(x[2], y[2])] for i, c in cases.items()})


def test_calculus(make, cases):
    a = make("a")
    diffs, sums, parts, gaps = {}, {}, {}, {}
    for i, c in cases.items():
        runs, total, part, gap = c["a"], 0.0, 0.0, 0
        diffs[i], sums[i], parts[i], gaps[i] = [], [], [], []
        for k, (s, e, v) in enumerate(runs):
            before = runs[k - 1] if k else None
            area = (v + before[2]) / 2 * (s - before[0]) if before else 0.0
            jump = before is not None and before[1] < s
            gap += jump
            total, part = total + area, 0.0 if jump else part + area
            diffs[i].append((s, e, v - before[2] if before else 0.0))
            sums[i].append((s, e, total))
            parts[i].append((s, e, part))
            gaps[i].append((s, e, gap))
    check(a.diff(), diffs)
    check(a.cumtrapz(), sums)
    check(a.cumtrapz(cum_across_uncontinuous_intervals=False), parts)
    found = {}
    for r in a.continuity().collect():
        found.setdefault(r["container_id"], []).append((r["tstart"], r["tend"], r["part"]))
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x) for i, x in gaps.items() if x}
    integral = {r["container_id"]: r["value"] for r in a.trapz().collect()}
    assert all(math.isclose(integral[i], s[-1][2]) for i, s in sums.items() if s)


def test_resample(make, cases):
    want = {}
    for i, c in cases.items():
        want[i] = []
        if c["a"]:
            lo, hi = c["a"][0][0], max(r[1] for r in c["a"])
            for t in range(lo, hi + 1, 4):
                v = value_at(c["a"], t)
                if v is not None:
                    want[i].append((t, min(t + 4, hi), v))
    check(make("a").resample(4), want)


def test_within_intervals(make, cases):
    a, iv = make("a"), make("iv")
    top, mean = {}, {}
    for i, c in cases.items():
        per = {}
        for s, e, x, y in cross(c["a"], merge(c["iv"])):
            per.setdefault(y, []).append((x[2], e - s))
        top[i] = [(*y, max(v for v, _ in m)) for y, m in per.items()]
        mean[i] = [(*y, sum(v * w for v, w in m) / sum(w for _, w in m)) for y, m in per.items()]
    check(a.max_within_intervals(iv), top)
    check(a.mean_within_intervals(iv), mean)
    all_three = {}
    for r in a.within_intervals(iv).collect():
        all_three.setdefault(r["container_id"], []).append((r["tstart"], r["tend"], r["max"], r["mean"]))
    for i in cases:
        want = sorted((*t, m[2]) for t, m in zip(sorted(top[i]), sorted(mean[i])))
        found = sorted(all_three.get(i, []))
        assert len(found) == len(want) and all(f[:3] == w[:3] and math.isclose(f[3], w[3]) for f, w in zip(found, want))


def test_many_conditions_in_one_pass(make, cases):
    tests = {"gt": lambda v: v > 1, "eq": lambda v: v == 2, "ne": lambda v: v != 0, "never": lambda v: v > 9}
    found = {}
    for r in make("a").meeting(tests).collect():
        found.setdefault((r["condition"], r["container_id"]), []).append((r["tstart"], r["tend"]))
    for name, test in tests.items():
        for i, c in cases.items():
            assert sorted(found.get((name, i), [])) == merge([(s, e) for s, e, v in c["a"] if test(v)]), (name, i)


def test_instances_are_numbered(make, cases):
    rows = make("p").instances().collect()
    found = {}
    for r in rows:
        found.setdefault(r["container_id"], []).append((r["event_number"], r["t"]))
    for i, c in cases.items():
        assert sorted(found.get(i, [])) == list(enumerate(c["p"], 1))
    assert len({r["event_instance_id"] for r in rows}) == len(rows)


def test_pit_series_with_sample_series(spark, make, cases, grid):
    pits = make("b").where(make("p"))
    mine, other = pits.synchronized(make("a"))
    want = {
        i: [
            (t, value_at(c["b"], t), value_at(c["a"], t))
            for t in c["p"]
            if value_at(c["b"], t) is not None and value_at(c["a"], t) is not None
        ]
        for i, c in cases.items()
    }
    check(mine, {i: [(t, b) for t, b, _ in w] for i, w in want.items()})
    check(other, {i: [(t, a) for t, _, a in w] for i, w in want.items()})
    assert isinstance(mine, PitSeries)


def test_long_runs_are_not_copied(spark):
    """A run that lasts for millions of slices is one row on the way, and gives the same answer."""
    from seriesloom.operators.align import locate, overlaps

    runs = "container_id bigint, tstart bigint, tend bigint, value double"
    slow = spark.createDataFrame([(1, 0, 10**13, 1.0), (1, 10**13, 2 * 10**13, 2.0)], runs)
    fast = spark.createDataFrame([(1, 10**12 + i, 10**12 + i + 1, float(i)) for i in range(200)], runs)
    points = spark.createDataFrame([(1, 5), (1, 10**13), (1, 3 * 10**13)], "container_id bigint, t bigint")
    plain, sliced = TimeGrid(1000), TimeGrid(1000, 7)
    for grid in (plain, sliced):
        met = overlaps({"a": slow, "b": fast}, grid)
        assert met.count() == 200 and met.where("a.value = 1.0 AND tend - tstart = 1").count() == 200
        held = {r["t"]: r["run"]["value"] for r in locate(points, slow, grid).collect()}
        assert held == {5: 1.0, 10**13: 2.0}
        merged = Intervals(slow.select("container_id", "tstart", "tend"), grid).merge_overlaps().frame.collect()
        assert [(r["tstart"], r["tend"]) for r in merged] == [(0, 2 * 10**13)]

"""As-of joins, two-level scans, order statistics and last rows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from zonelake.operators import asof, intervals, order_stats, series, tracks

HOT = [("hot",)] * 6 + [("a",), ("b",), (None,)]


@pytest.fixture(scope="module")
def rng():
    return random.Random(12)


def test_as_of(spark, rng):
    """Ties in time, instants at a reading, keys without readings, chunks without either; one key has most rows."""
    readings = [(*rng.choice(HOT), rng.randrange(0, 1000), k, rng.choice([None, k])) for k in range(300)]
    asked = [(*rng.choice([*HOT, ("none",)]), rng.randrange(-50, 1500), k) for k in range(300)]
    rows = spark.createDataFrame(readings, "k string, ts_us long, seq long, v long")
    given = spark.createDataFrame(asked, "k string, at_us long, found string")
    for chunk in (7, 100, 10**6):
        out = asof.as_of(given, rows, ["k"], "row", chunk_us=chunk).collect()
        got = {r.found: r.row and (r.row.ts_us, r.row.seq, r.row.v) for r in out}
        want = {str(n): max(((t, s, v) for k, t, s, v in readings if k == key and key is not None and t <= at), default=None, key=lambda x: x[:2]) for key, at, n in asked}
        assert got == want and len(out) == len(asked)


def test_as_of_keeps_rows_single(spark):
    rows = spark.createDataFrame([("a", 1, 1, 5)], "k string, ts_us long, seq long, v long")
    given = spark.createDataFrame([("a", 3)], "k string, at_us long")
    plan = asof.as_of(given, rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_zone_at(spark):
    """Hand-computed: an hour's hold, an outage from 100 to 200, both ends included."""
    read = spark.createDataFrame([("c", "z", 0, 1, 4), ("c", "z", 90, 2, 7), ("d", "z", 50, 3, 1)], "camera_id string, zone_id string, ts_us long, seq long, occupancy long")
    out = spark.createDataFrame([("c", 100, 150), ("c", 150, 200)], "camera_id string, a_us long, b_us long")
    at = spark.createDataFrame([("c", "z", t) for t in (-1, 0, 89, 100, 200, 201, 400)] + [("d", "z", 100)], "camera_id string, zone_id string, at_us long")
    got = [(r.camera_id, r.at_us, r.state and r.state.occupancy, r.age_us, r.stale, r.camera_offline, r.trustworthy) for r in asof.zone_at(at, read, out, 150).orderBy("camera_id", "at_us").collect()]
    assert got == [
        ("c", -1, None, None, None, False, None), ("c", 0, 4, 0, False, False, True), ("c", 89, 4, 89, False, False, True), ("c", 100, 7, 10, False, True, False),
        ("c", 200, 7, 110, False, True, False), ("c", 201, 7, 111, False, False, True), ("c", 400, 7, 310, True, False, False), ("d", 100, 1, 50, False, False, True),
    ]


def test_scan(spark, rng):
    rows = [(*rng.choice(HOT[:-1]), rng.randrange(500), k, rng.choice([None, rng.randrange(-9, 9)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, s long, v long")
    for inclusive in (True, False):
        values = {"hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "sum_": ("sum", F.col("v"))}
        got = {r.s: (r.hi, r.lo, r.sum_) for r in intervals.scan(df, ["k"], values, ["t", "s"], inclusive, 37).collect()}
        for k, t, s, _ in rows:
            seen = [v for k2, t2, s2, v in rows if k2 == k and v is not None and ((t2, s2) <= (t, s) if inclusive else (t2, s2) < (t, s))]
            assert got[s] == ((max(seen), min(seen), sum(seen)) if seen else (None, None, None))


def test_merge_and_offline(spark, rng):
    day = intervals.DAY
    spans = [(*rng.choice(HOT[:-1]), a, a + rng.choice([0, -5, 1, day // 3, 2 * day])) for a in (rng.randrange(30) * day // 4 for _ in range(80))]
    got = sorted(tuple(r) for r in intervals.merge(spark.createDataFrame(spans, "k string, a_us long, b_us long"), ["k"]).collect())
    want = []
    for k, a, b in sorted(x for x in spans if x[2] > x[1]):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1][2] = max(want[-1][2], b)
        else:
            want.append([k, a, b])
    assert got == [tuple(x) for x in want]
    kinds = ["CAMERA_OFFLINE", "CAMERA_ONLINE", "CAMERA_RECOVERED", "OTHER"]
    events = [(rng.choice(["c", "d"]), rng.randrange(40) * day // 3, k, rng.choice(kinds)) for k in range(60)]
    down, want, end = {}, [], 20 * day
    for c, t, _, kind in sorted(events):
        if kind == kinds[0]:
            down.setdefault(c, t)
        elif kind != kinds[3] and c in down:
            want.append((c, down.pop(c), t))
    want = sorted((c, max(a, day), min(b, end)) for c, a, b in [*want, *((c, t, end) for c, t in down.items())] if min(b, end) > max(a, day))
    found = intervals.offline(spark.createDataFrame(events, "camera_id string, ts_us long, seq long, event_type string"), day, end)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_no_window_over_the_rows_of_a_camera(spark):
    """Windows are by chunk, or over what touches a chunk's edges; those by key alone are over chunk summaries: their input is an aggregate
    or the last row of a chunk."""
    events = spark.createDataFrame([("c", 1, 1, "CAMERA_OFFLINE")], "camera_id string, ts_us long, seq long, event_type string")
    for df in (intervals.offline(events, 0, 9), tracks.silences(events, 1, 1), intervals.merge(intervals.offline(events, 0, 9), ["camera_id"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        for k, line in enumerate(plan):
            if "Window [" in line and not any(x in line.split("], [")[1] for x in ("__chunk", "__bin", "__apart")):
                below = "".join(plan[k + 1 : k + 8])
                assert "Aggregate [" in below or "__place" in below, line


def test_order_statistics(spark, rng):
    groups = {"one": [5.0], "equal": [2.0] * 50, "many": [rng.gauss(0, 1) for _ in range(2000)], "skew": [0.0] * 900 + [rng.random() for _ in range(100)], "nulls": [None, 3.0, None, 1.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None)]
    found = order_stats.select(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": lambda n: n * 0, "q3": order_stats.upper_quantile(0.75), "mid": order_stats.upper_median, "hi": lambda n: n - 1})
    got = {r.k: (r.n, r.lo, r.q3, r.mid, r.hi) for r in found.collect()}
    for k, vs in groups.items():
        v = sorted(x for x in vs if x is not None)
        assert got[k] == (len(v), v[0], v[min(len(v) - 1, int(len(v) * 0.75))], v[len(v) // 2], v[-1])
    assert "empty" not in got


def test_latest_has_no_sort_of_the_rows(spark, rng):
    rows = [(rng.choice(["c", None]), rng.choice("yz"), rng.choice([None, *range(-3, 4)]), rng.choice([None, *range(5)]), k) for k in range(200)]
    df = spark.createDataFrame(rows + rows[:20], "camera_id string, zone_id string, ts_us long, seq long, v long")
    found = series.latest(df)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    low = lambda x: -(2**62) if x is None else x
    got = {(r.camera_id, r.zone_id): (low(r.ts_us), low(r.seq)) for r in found.collect()}
    assert got == {k: max((low(t), low(s)) for c, z, t, s, _ in rows if (c, z) == k) for k in {r[:2] for r in rows}}
    assert found.count() == len(got)

"""Literal cases of the sparse-series algebra, one key, times in seconds."""

import pytest
from pyspark.sql import functions as F

from zonelake.functions import scalars
from zonelake.operators import intervals, series, store

S = 1_000_000


def readings(spark, rows):
    """(seconds, occupancy) pairs, some with a density."""
    made = [("C", "Z", int(r[0] * S), i, r[1], None if r[1] is None else r[1] / 10) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, "camera_id string, zone_id string, ts_us long, seq long, occupancy long, density double")


def outages(spark, spans=()):
    return spark.createDataFrame([("C", int(a * S), int(b * S)) for a, b in spans], "camera_id string, a_us long, b_us long")


def buckets(spark, rows, t0, t1, step, spans=(), hold=None):
    out = series.bucket_series(readings(spark, rows), outages(spark, spans), t0 * S, t1 * S, step * S, "occupancy", hold and hold * S)
    return out.orderBy("bucket_us").collect()


def test_carry_into_empty_buckets(spark):
    got = buckets(spark, [(0, 4)], 0, 900, 300)
    assert [r.occupancy for r in got] == [4, 4, 4]


def test_prior_opens_the_window(spark):
    assert [r.occupancy for r in buckets(spark, [(-5000, 7), (600, 0)], 0, 900, 300)] == [7, 7, 0]


def test_two_readings_in_a_bucket(spark):
    assert buckets(spark, [(0, 2), (150, 6)], 0, 300, 300)[0].occupancy == 4.0


def test_outage_is_a_hole(spark):
    got = buckets(spark, [(0, 4)], 0, 900, 300, [(300, 600)])
    assert [r.occupancy for r in got] == [4, None, 4] and [r.coverage for r in got] == [1, 0, 1]


def test_hold_ends(spark):
    got = buckets(spark, [(0, 9)], 0, 900, 300, hold=60)
    assert [r.occupancy for r in got] == [9, None, None] and [r.peak_occupancy for r in got] == [9, 9, 9]
    assert [r.coverage for r in got] == [0.2, 0, 0]


def test_edge_buckets_are_not_clipped(spark):
    got = buckets(spark, [(950, 3)], 1000, 1600, 300)
    assert [r.bucket_us // S for r in got] == [900, 1200, 1500] and [r.coverage for r in got][1:] == [1, 1]


def test_bucket_step():
    assert series.bucket_step(0, 6000 * S) == 100 * S and series.bucket_step(0, 6000 * S, S) >= 6 * S
    assert (6000 * S) / series.bucket_step(0, 6000 * S, S) <= 1000


def weighted(spark, rows, t0, t1, spans=(), hold=None):
    return series.time_weighted(readings(spark, rows), outages(spark, spans), t0 * S, t1 * S, ["occupancy", "density"], hold and hold * S).first()


def test_even_cadence_equals_the_mean(spark):
    got = weighted(spark, [(0, 1), (10, 2), (20, 3), (30, 6)], 0, 40)
    assert got.mean_occupancy == 3 and (got.peak_occupancy, got.min_occupancy, got.samples) == (6, 1, 4)


def test_weight_is_time(spark):
    assert weighted(spark, [(0, 0), (90, 10)], 0, 100).mean_occupancy == 1


def test_outage_leaves_the_denominator(spark):
    got = weighted(spark, [(0, 4), (50, 8)], 0, 100, [(50, 100)])
    assert got.mean_occupancy == 4 and got.peak_occupancy == 8 and got.coverage == 0.5 and got.observed_us == 50 * S


def test_null_values_are_skipped_but_counted(spark):
    got = weighted(spark, [(0, 4), (50, None)], 0, 100)
    assert got.mean_occupancy == 4 and got.samples == 2 and got.peak_occupancy == 4


def test_stale_prior_is_trusted_from_the_window_on(spark):
    got = weighted(spark, [(-10_000, 5)], 0, 100, hold=30)
    assert got.mean_occupancy == 5 and got.coverage == 0.3
    at = series.state_at(readings(spark, [(-10_000, 5)]), [10 * S], 30 * S).first()
    assert at.stale and at.age_us == 10_010 * S


def test_state_at(spark):
    rows = readings(spark, [(0, 1), (100, 2), (100, 3)])
    got = {r.at_us // S: r.occupancy for r in series.state_at(rows, [-1 * S, 0, 99 * S, 100 * S, 500 * S], None).collect()}
    assert got == {0: 1, 99: 1, 100: 3, 500: 3}


def test_duration_and_episodes(spark):
    rows = readings(spark, [(0, 5), (10, 0), (20, 7), (40, 9), (60, 0)])
    args = (outages(spark, [(25, 30)]), 0, 100 * S, scalars.comparison("occupancy", "gt", 4))
    got = series.duration_where(rows, *args, 1000 * S).first()
    assert (got.total_us, got.episode_count, got.longest_us, got.unobserved_us, got.coverage) == (45 * S, 3, 30 * S, 5 * S, 0.95)
    assert [(r.a_us // S, r.b_us // S) for r in series.episodes(rows, *args, 1000 * S).orderBy("a_us").collect()] == [(0, 10), (20, 25), (30, 60)]


def test_comparison_is_closed(spark):
    with pytest.raises(ValueError):
        scalars.comparison("name", "gt", 1)
    with pytest.raises(ValueError):
        scalars.comparison("density", "like", 1)


def test_gaps(spark):
    got = series.find_gaps(readings(spark, [(100, 1), (900, 1)]), outages(spark, [(250, 300)]), 0, 1000 * S, 100 * S)
    found = sorted((r.a_us // S, r.b_us // S, r.reason) for r in got.collect())
    assert found == [(0, 100, "no_data"), (200, 250, "no_data"), (250, 300, "camera_offline"), (300, 900, "no_data")]


def test_offline_intervals(spark):
    e = [(5, "CAMERA_ONLINE"), (10, "CAMERA_OFFLINE"), (12, "CAMERA_OFFLINE"), (20, "CAMERA_RECOVERED"), (90, "CAMERA_OFFLINE")]
    events = spark.createDataFrame([("C", t * S, i, k) for i, (t, k) in enumerate(e)], "camera_id string, ts_us long, seq long, event_type string")
    assert sorted((r.a_us // S, r.b_us // S) for r in intervals.offline(events, 15 * S, 100 * S).collect()) == [(15, 20), (90, 100)]


def test_merge_and_subtract(spark):
    rows = spark.createDataFrame([("k", 5, 9), ("k", 0, 3), ("k", 3, 4), ("k", 7, 12), ("k", 20, 20), ("j", 1, 2)], "camera_id string, a_us long, b_us long")
    assert sorted(map(tuple, intervals.merge(rows, ["camera_id"]).collect())) == [("j", 1, 2), ("k", 0, 4), ("k", 5, 12)]
    blind = spark.createDataFrame([("k", 2, 3), ("k", 8, 30)], "camera_id string, a_us long, b_us long")
    whole = spark.createDataFrame([("k", 0, 40, "x")], "camera_id string, a_us long, b_us long, tag string")
    for size in (4, 7, 1000):
        cut = intervals.merge(intervals.subtract(whole, blind, ["camera_id"], size), ["camera_id"])
        assert sorted((r.a_us, r.b_us) for r in cut.collect()) == [(0, 2), (3, 8), (30, 40)]
        assert intervals.overlap_us(whole, blind, ["camera_id"], ["tag"], size).first().overlap_us == 23


def test_hold_forward_across_chunks(spark):
    rows = readings(spark, [(0, 1), (5, 2), (300_000, 3), (300_001, 4), (900_000, 5)])
    got = [r.next_us and r.next_us // S for r in intervals.hold_forward(rows, series.KEY).orderBy("ts_us").collect()]
    assert got == [5, 300_000, 300_001, 900_000, None]


def test_live_row_never_moves_back(spark):
    assert store.live_rows(readings(spark, [(10, 1), (5, 2), (10, 3)])).first().occupancy == 3


def test_resolve_zone(spark):
    zones = spark.createDataFrame([("A", "Z1"), ("B", "Z1"), ("A", "Z2")], "camera_id string, zone_id string")
    assert store.resolve_zone(zones, zones, "Z2") == ("A", "Z2") and store.resolve_zone(zones, zones, "Z1", "B") == ("B", "Z1")
    with pytest.raises(ValueError, match="A, B"):
        store.resolve_zone(zones, zones, "Z1")
    with pytest.raises(LookupError):
        store.resolve_zone(zones, zones, "Z9")


def test_weighted_invariant(spark):
    """Observed and unobserved time add up to the window, for several keys of random readings."""
    import random

    rng = random.Random(1)
    made = [("C", f"Z{rng.randrange(3)}", rng.randrange(0, 10_000) * S, i, rng.randrange(9), 0.0) for i in range(200)]
    rows = spark.createDataFrame(made, "camera_id string, zone_id string, ts_us long, seq long, occupancy long, density double")
    down = outages(spark, [(1000, 1500), (1400, 2000), (9000, 9100)])
    gaps = series.find_gaps(rows, down, 0, 10_000 * S, 60 * S).groupBy("zone_id").agg(F.sum(F.col("b_us") - F.col("a_us")).alias("lost"))
    both = series.time_weighted(rows, down, 0, 10_000 * S, ["occupancy"], 60 * S).join(gaps, "zone_id").collect()
    assert len(both) == 3 and all(r.observed_us + r.lost == 10_000 * S for r in both)

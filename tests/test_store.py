"""Runs and folds against stepping row by row, registry with ends of tracks, store writes, sinks and validation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from zonelake.functions import identity as idf
from zonelake.functions import scalars, validate
from zonelake.operators import folds, identity, store, tracks
from zonelake.operators import intervals as iv
from zonelake.plans import reports
from zonelake.sources import tables
from zonelake.streaming import operators as streaming

S = 1_000_000
DAY = 86_400 * S


def readings(spark, rng, n=400, zones=2):
    """Over several days, with ties in time and null values."""
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice((0, 1, 60, 3600, 40_000)) * S
        occupancy = rng.choice((None, 0, 3, 3, 9))
        rows.append((i, ts, "C", f"Z{rng.randrange(zones)}", occupancy, None if occupancy is None else occupancy / 2.0, None if occupancy is None else occupancy * 11.0, rng.choice(("NORMAL", None, "WARNING"))))
    return rows, spark.createDataFrame(rows, folds.STATE_ROW)


def by_zone(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[3], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_by_runs_equal_steps(spark, seed):
    rows, frame = readings(spark, random.Random(seed))
    zones = by_zone(rows)
    for keepalive in (0, 3600 * S):
        want = {r[0] for z in zones.values() for g in [folds.WriteGate(keepalive)] for r in z if g.step(r[1], r[4], r[7])}
        assert {r.seq for r in folds.gated(frame, keepalive).collect()} == want
    for sustain in (0, 3600 * S):
        want = {x[:7] for z in zones.values() for latches in [folds.zone_latches(sustain)] for r in z for x in folds.latch_step(latches, {"camera_id": "C", "zone_id": r[3], "seq": r[0], "ts_us": r[1], "density": r[5], "capacity_pct": r[6]})}
        assert {tuple(r)[:7] for r in folds.zone_alerts(frame, sustain).collect()} == want and want
    sights = frame.select(F.lit("C").alias("camera_id"), F.lit(1).cast("long").alias("track_id"), "seq", "ts_us", F.when(F.col("occupancy") == 3, "A").when(F.col("occupancy") == 9, "B").alias("zone_id"))
    for n in (1, 2, 3):
        d, want = folds.Debouncer(n), []
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            before, zone = d.confirmed, {3: "A", 9: "B"}.get(r[4])
            want += [(r[0], before, zone)] if d.step(zone) else []
        assert sorted((r.seq, r.zone_from, r.zone_to) for r in folds.debounced(sights, ["camera_id", "track_id"], n).collect()) == want and want


def test_streaming_debounce_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [("C", i % 3, i, i * S, rng.choice(("A", "A", "B", None))) for i in range(300)]
    frame = spark.createDataFrame(rows, "camera_id string, track_id long, seq long, ts_us long, zone_id string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    found = streaming.finish(lambda end: streaming.debounced(read(), 2, closing=end), spark, str(tmp_path / "s"))
    assert sorted(map(str, found.collect())) == sorted(map(str, folds.debounced(frame, ["camera_id", "track_id"], 2).select(*found.columns).collect()))


def test_own_limits(spark):
    frame = spark.createDataFrame([(i, i * S, "C", z, 0, v, 0.0, "x") for i, (z, v) in enumerate([("A", 1.5), ("B", 1.5), ("A", 0.95), ("A", 0.9), ("B", 2.0)])], folds.STATE_ROW)
    limits = spark.createDataFrame([("C", "A", 1.0, 9.0)], "camera_id string, zone_id string, warning_density double, critical_density double")
    got = sorted((r.zone_id, r.ts_us // S, r.rule_id, r.kind) for r in folds.zone_alerts(frame, 0, limits=limits).collect())
    assert got == [("A", 0, "R-01", "FIRE"), ("A", 3, "R-01", "CLEAR"), ("B", 4, "R-01", "FIRE")]


def test_changes_and_observed(spark):
    frame = spark.createDataFrame([(i, ts * S, "C", "Z", o) for i, (ts, o) in enumerate([(0, 1), (10, 1), (86_400, 4), (200_000, 2)])], "seq long, ts_us long, camera_id string, zone_id string, occupancy long")
    got = sorted((r.ts_us // S, r.previous, r.occupancy, r.held_until_us and r.held_until_us // S) for r in store.changes(frame).collect())
    assert got == [(86_400, 1, 4, 200_000), (200_000, 4, 2, None)]
    spans = spark.createDataFrame([("C", 1, 0, 3 * DAY), ("C", 2, 5, 5), ("C", 3, DAY - 10, DAY + 10)], "k string, id long, a_us long, b_us long")
    holes = spark.createDataFrame([("C", DAY - 5, DAY + 5), ("C", 2 * DAY, 2 * DAY + 7)], "k string, a_us long, b_us long")
    seen = {r.id: (r.n, r.seen) for r in iv.observed(spans, holes, ["k"]).groupBy("id").agg(F.count_if("once").alias("n"), F.sum("seen_us").alias("seen")).collect()}
    assert seen == {1: (1, 3 * DAY - 17), 2: (1, 0), 3: (1, 10)}
    over = {r.id: r.overlap_us for r in iv.overlap_us(spans, holes, ["k"], ["id"]).collect()}
    assert over == {1: 17, 3: 10}


# Identity


def vector(k, n=32):
    rng = random.Random(k)
    return [rng.gauss(0, 1) for _ in range(n)]


def test_registry_ends_bound_its_state(spark):
    """Thousands of tracks that end leave few people; tracks that don't end keep theirs."""
    registry = identity.Registry({}, "s")
    for k in range(3000):
        registry.resolve("C", k, [vector(k)], k * S)
        registry.release(("C", k))
    assert len(registry.people) <= identity.GALLERY and not registry.bound and len(registry.apart) == 0
    for k in range(5):
        registry.resolve("D", k, [vector(10_000 + k)], 4000 * S)
    assert len(registry.bound) == 5 and len(registry.apart) == 10
    registry.release_camera("D")
    assert not registry.bound and not any(p.active for p in registry.people.values())


def test_resolve_with_ends(spark):
    seen = [("S", "C", t, t * 10 * S, t, [vector(0)]) for t in (1, 2)]
    schema = "site_id string, camera_id string, track_id long, ts_us long, seq long, vectors array<array<double>>"
    ends = lambda *rows: spark.createDataFrame(rows, "site_id string, camera_id string, track_id long, ts_us long, seq long")
    frame = spark.createDataFrame(seen, schema)
    refs = lambda e: [r.global_ref for r in identity.resolve(frame, [], "s", e).orderBy("ts_us").collect()]
    apart, own, camera = refs(None), refs(ends(("S", "C", 1, 15 * S, 9))), refs(ends(("S", "C", None, 15 * S, 9)))
    assert apart[0] != apart[1] and own[0] == own[1] and camera[0] == camera[1]
    resolved = identity.resolve(frame, [], "s")
    live = lambda e, at: [(r.people, r.tracks) for r in identity.occupancy(resolved, e, at).collect()]
    assert live(ends(("S", "C", 1, 15 * S, 9)), 30 * S) == [(1, 1)] and live(ends(("S", "C", None, 15 * S, 9)), 16 * S) == [] and live(ends(), 30 * S) == [(2, 2)]


def test_best_match_in_blocks(spark, monkeypatch):
    gallery = spark.createDataFrame([(k, vector(k)) for k in range(40)], "k long, mean array<double>")
    probes = spark.createDataFrame([(t, vector(t)) for t in (3, 17, 99)], "t long, v array<double>")
    found = lambda: sorted(map(tuple, identity.best_match(probes, gallery, "t", "v", "k").collect()))
    whole = found()
    monkeypatch.setattr(identity, "GALLERY", 7)
    assert found() == whole and [r[1] for r in whole[:2]] == [3, 17]


def test_bank_similarity(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], [[1.0, 0.0]], [[0.0, 1.0], [1.0, 0.0]])], "a array<double>, b array<double>, x array<array<double>>, y array<array<double>>")
    assert row.select(idf.bank_similarity(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.9)


def test_clusters(spark):
    rng = random.Random(3)
    rows = [("C", f, i, rng.uniform(0, 300), rng.uniform(0, 300)) for i, f in enumerate(sorted(rng.randrange(40) for _ in range(150)))]
    frame = spark.createDataFrame([(c, f, i, x - 5, y - 5, x + 5, y + 5) for c, f, i, x, y in rows], "camera_id string, ts_us long, seq long, x1 double, y1 double, x2 double, y2 double")
    members, want = [], {}
    for _, f, i, x, y in rows:
        centre = [(sum(p[0] for p in m) / len(m), sum(p[1] for p in m) / len(m)) for m in members]
        free = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, k) for k, (a, b) in enumerate(centre) if f not in [p[2] for p in members[k]]]
        near = min(free, default=(1e9, 0))
        k = near[1] if near[0] <= 40 else len(members)
        members += [[]] if k == len(members) else []
        members[k].append((x, y, f))
        want[i] = k
    assert {r.seq: r.cluster for r in tracks.position_clusters(frame, 40.0).collect()} == want


# Store


def test_retention_by_day(spark, tmp_path):
    path = str(tmp_path / "d")
    tables.write_by_day(spark.createDataFrame([("C", float(d * 86_400)) for d in range(4)], "camera_id string, ts double"), path)
    assert store.retain_days(spark, path, 2 * DAY + 5) == ["1970-01-01", "1970-01-02"]
    assert spark.read.parquet(path).count() == 2 and store.retain_days(spark, path, 0) == []


def test_alerts_reports_and_pages(spark):
    alerts = spark.createDataFrame([(1, "OPEN", "f1"), (2, "RESOLVED", "f2"), (3, "DISMISSED", None), (4, None, "f4")], "id long, status string, frame string")
    kept, frames = store.delete_alerts(alerts)
    assert sorted(r.id for r in kept.collect()) == [1, 4] and [r.frame for r in frames.collect()] == ["f2"]
    assert store.delete_alerts(alerts, "all")[0].count() == 0
    with pytest.raises(ValueError):
        store.delete_alerts(alerts, "some")
    rows = spark.createDataFrame([("a", "Z1", None), ("a", "Z2", 4), ("b", "Z3", 1)], "scope string, zone_id string, n long")
    stored = reports.report_records(rows, "scheduled", 9, 0, 5)
    assert sorted(map(tuple, reports.get_report(stored, "a", 9, "zone_id string, n long").collect()), key=str) == [("Z1", None), ("Z2", 4)]
    assert [r.scope for r in reports.list_reports(stored, 1).collect()] == ["a"] and "payload" not in reports.list_reports(stored).columns
    assert reports.due(None, 5, 10) and reports.due(0, 10, 10) and not reports.due(1, 10, 10)
    some = spark.createDataFrame([(i, i) for i in range(5)], "seq long, ts_us long")
    assert [(r.seq, r.has_more) for r in store.page(some, 2, 1).collect()] == [(3, True), (2, True)]
    assert [(r.seq, r.has_more) for r in store.page(some, 3, 2).collect()] == [(2, False), (1, False), (0, False)]
    cursors = lambda *rows: spark.createDataFrame(rows, "name string, ts_us long")
    assert sorted(map(tuple, store.merge_cursors(cursors(("a", 5), ("b", 5)), cursors(("a", 2))).collect())) == [("a", 2), ("b", 5)]


def test_small_columns(spark):
    rows = spark.createDataFrame([("resolved", 1_500_000), (None, 0)], "status string, ts_us long")
    assert rows.where(scalars.has_status("RESOLVED")).count() == 1 and rows.where(scalars.has_status("")).count() == 1
    assert str(rows.select(store.utc(F.col("ts_us"))).first()[0]).endswith("00:00:01.500000")
    assert json.loads(store.to_json({"b": 1, "a": "ü"})) == {"a": "ü", "b": 1}
    moves = spark.createDataFrame([("C", 5, "A", "B")], "camera_id string, ts_us long, zone_to string, zone_from string")
    sights = spark.createDataFrame([("C", 5, 1, "A"), ("C", 5, 2, "A"), ("C", 6, 3, "B")], "camera_id string, ts_us long, track_id long, zone_id string")
    stamped = tracks.stamp_occupancy(moves, sights).first()
    assert (stamped.occupancy, stamped.occupancy_from) == (2, 0)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("e", 1, None), ("a", 2, "x,y")], "kind string, n long, note string")
    tables.write_json_lines(rows, str(tmp_path / "j"), "kind")
    lines = [r.payload for r in tables.read_json_lines(spark, str(tmp_path / "j" / "kind=e")).collect()]
    assert [json.loads(x) for x in lines] == [{"n": 1, "note": None}]
    tables.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "c")).collect()), key=str) == [("a", "2", "x,y"), ("e", "1", None)]


def test_validation(spark):
    errors = lambda text: spark.createDataFrame([(text,)], "p string").select(validate.tuning_errors(F.col("p"))).first()[0]
    assert errors('{"threshold": 0.5, "margin": 0, "ttl_seconds": "30"}') == [] and errors("{}") == ["nothing to change: send threshold, margin or ttl_seconds"]
    assert errors("[]") == errors("nonsense") == errors(None) == ["payload must be an object"]
    assert len(errors('{"threshold": 0, "margin": "NaN", "ttl_seconds": null}')) == 3 and errors('{"margin": "Infinity"}') == ["margin must be a number >= 0 and finite"]
    good = ("Z", "C", 2, 0.5, 10.0, 1.0, 0.0, "NORMAL", 1)
    names = "zone_id string, camera_id string, occupancy long, density double, capacity_pct double, inflow double, outflow double, status string, ts_us long"
    check = lambda row: spark.createDataFrame([row], names).select(validate.zone_state_errors()).first()[0]
    assert check(good) == [] and check(("Z", "C", -2, 0.5, 10.0, None, 0.0, "odd", 1)) == ["inflow: missing", "occupancy: negative", "status: unknown"]
    zones = spark.createDataFrame([("Z", "restricted", [1, 2, 3], 1, 1.0, 2.0, 4.0), (None, "odd", [1], -1, 1.0, 2.0, None)], "zone_id string, zone_type string, polygon array<int>, capacity_max long, area_sqm double, warning_density double, critical_density double")
    found = [r[0] for r in zones.select(validate.zone_errors()).collect()]
    assert found[0] == [] and len(found[1]) == 4

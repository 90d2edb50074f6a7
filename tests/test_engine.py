"""Literal cases of folds, tracks, identity, geometry, validation and streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zonelake.functions import identity as idf
from zonelake.functions import validate
from zonelake.operators import folds, geometry, identity, store, tracks
from zonelake.plans import queries, reports
from zonelake.streaming import operators as streaming

S = 1_000_000


def test_latch():
    amber = folds.Latch(2.0, 1.8, 0)
    assert [amber.step(v, t * S) for t, v in enumerate([1.9, 2.0, 1.9, 1.8])] == [None, "FIRE", None, "CLEAR"]
    held = folds.Latch(2.0, 1.8, 10 * S)
    assert [held.step(v, t * S) for t, v in [(0, 3), (5, 3), (6, 1), (7, 3), (16, 3), (17, 3), (18, 1), (28, 1)]] == [None] * 5 + ["FIRE", None, "CLEAR"]
    assert folds.Latch(90, 85, 0, armed=True).step(87, 0) is None


def test_debouncer():
    d = folds.Debouncer(3)
    assert [d.step(z) for z in ["A", "A", "A", "B", "B", "A", "B", "B", "B"]] == [False, False, True, False, False, False, False, False, True]


def test_write_gate():
    g = folds.WriteGate(300 * S)
    assert [g.step(t * S, o, "N") for t, o in [(0, 1), (5, 1), (10, 2), (309, 2), (310, 2), (311, 2)]] == [True, False, True, False, True, False]


def test_flow_and_dwell(spark):
    rows = spark.createDataFrame([("C", "Z", t * S, i, k) for i, (t, k) in enumerate([(0, "in"), (30, "in"), (60, "out"), (61, "in")])], "camera_id string, zone_id string, ts_us long, seq long, kind string")
    got = {r.ts_us // S: r for r in tracks.flow_rates(rows).collect()}
    assert (got[60].inflow_1m, got[60].outflow_1m, got[60].net_flow, got[61].inflow_1m, got[61].inflow_5m) == (2.0, 1.0, 1.0, 2.0, 0.6)
    seen = spark.createDataFrame([(1, t * S, t, z) for t, z in [(0, "A"), (40, "A"), (50, None), (60, "A")]], "track_id long, ts_us long, seq long, zone_id string")
    stays = tracks.dwell(seen, ["track_id"])
    assert [r.dwell_us // S for r in stays.orderBy("ts_us").collect()] == [0, 40, 0, 0]
    assert [(r.ts_us // S, r.zone_id) for r in tracks.loitering(stays, ["track_id"]).collect()] == [(40, "A")]


def test_camera_silence(spark):
    beats = lambda *ts: spark.createDataFrame([("C", t * S) for t in ts], "camera_id string, ts_us long")
    assert tracks.silences(beats(0, 29)).count() == 0
    assert [(r.kind, r.ts_us // S) for r in tracks.silences(beats(0, 100)).orderBy("ts_us").collect()] == [("FIRE", 35), ("CLEAR", 100)]


def test_upper_quantile(spark):
    q = lambda *v: tracks.presence(spark.createDataFrame([("k", x) for x in v], "k string, v long"), ["k"], "v").first()["presence"]
    assert q(1) == 1 and q(1, 2, 3, 4) == 4 and q(5, 1, 4, 2, 3) == 4


def test_point_in_polygon(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(100, 100), (300, 100), (300, 300), (100, 300)]])
    inside = lambda x, y, p=square: spark.range(1).select(geometry.contains(p, F.lit(float(x)), F.lit(float(y)))).first()[0]
    assert inside(200, 200) and inside(100, 150) and inside(300, 300) and not inside(301, 200) and not inside(99, 99)
    assert not inside(200, 100, F.slice(square, 1, 2))


def test_zone_priority(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    zones = spark.createDataFrame([("C", "open", 0, False, corners), ("C", "closed", 1, True, corners)], "camera_id string, zone_id string, ord int, restricted boolean, polygon array<struct<x:double,y:double>>")
    points = spark.createDataFrame([("C", 5.0, 5.0), ("C", 50.0, 5.0), ("D", 5.0, 5.0)], "camera_id string, x double, y double")
    assert [r.zone_id for r in geometry.assign_zone(points, zones).orderBy("camera_id", "x").collect()] == ["closed", None, None]


A, A_ALT, B, LOOKALIKE, BETWEEN = [1, 0, 0], [0.98, 0.199, 0], [0, 1, 0], [0.99, 0.1411, 0], [0.9962, 0.0872, 0]
WALK = {("C1", "C2"): ("TRANSIT", 10 * S, 90 * S)}


def registry(**o):
    return identity.Registry(WALK, "s", unknown_ok=False, **o)


def test_identity_matches_after_a_walk():
    r = registry()
    a = r.resolve("C1", 1, [A, A], 0)
    assert r.resolve("C1", 1, [A], S)[4] == "existing_binding"
    r.release(("C1", 1))
    b = r.resolve("C2", 5, [A_ALT, A_ALT], 31 * S)
    assert b[0] == a[0] and b[4] == "appearance_match"


def test_physics_beats_appearance():
    r = registry()
    a = r.resolve("C1", 1, [A], 0)
    b = r.resolve("C2", 1, [A], 2 * S)
    assert b[0] != a[0] and b[4] == "no_candidates"


def test_co_present_people_are_never_merged():
    r = registry()
    a, b = r.resolve("C1", 1, [A], 0), r.resolve("C1", 2, [LOOKALIKE], 0)
    assert a[0] != b[0]
    c = r.resolve("C2", 1, [BETWEEN], 30 * S)
    assert c[4] == "ambiguous_margin" and c[0] not in (a[0], b[0])


def test_duplicates_consolidate():
    r = registry(threshold=0.7)
    a = r.resolve("C1", 1, [A], 0)
    b = r.resolve("C2", 1, [LOOKALIKE], 5 * S)
    assert a[0] != b[0]
    r.release(("C1", 1))
    r.release(("C2", 1))
    c = r.resolve("C2", 2, [BETWEEN], 40 * S)
    assert c[4] == "consolidated_duplicate" and len(r.people) == 1


def test_identities_expire():
    r = registry()
    r.resolve("C1", 1, [B], 0)
    r.release(("C1", 1))
    r.resolve("C2", 1, [A], 301 * S)
    assert len(r.people) == 1


def test_cosine_and_normalise(spark):
    row = spark.sql("select array(3.0, 4.0) a, array(0.0, 0.0) z, array(1.0) s").select(idf.cosine(F.col("a"), F.col("a")), idf.cosine(F.col("a"), F.col("z")), idf.l2_normalize(F.col("a"))).first()
    assert row[0] == pytest.approx(1) and row[1] == 0 and row[2] == [0.6, 0.8]
    with pytest.raises(Exception, match="differ in size"):
        spark.sql("select array(3.0, 4.0) a, array(1.0) s").select(idf.cosine(F.col("a"), F.col("s"))).collect()


def test_credentials(spark):
    urls = ["rtsp://u:p@ss@h/x", "rtsp://u@h", "rtsp://h/a@b", "rtsp://***:***@h", None]
    out = spark.createDataFrame([(u,) for u in urls], "u string").select(idf.mask_credentials(F.col("u")), idf.contains_credentials(F.col("u"))).collect()
    assert [tuple(r) for r in out] == [("rtsp://***:***@h/x", True), ("rtsp://***@h", True), ("rtsp://h/a@b", False), ("rtsp://***:***@h", False), (None, False)]


GOOD = {"event_type": "DENSITY_UPDATE", "event_id": "e", "camera_id": "c", "site_id": "s", "timestamp": 1.5, "zone_id": "z", "occupancy": 3, "density": 0.1}


@pytest.mark.parametrize(("change", "n"), [({}, 0), ({"occupancy": "3"}, 1), ({"occupancy": True}, 1), ({"occupancy": 3.5}, 1), ({"occupancy": -1}, 1), ({"density": None, "zone_id": ""}, 2), ({"event_type": "X"}, 1), ({"timestamp": -1, "site_id": 5}, 2), ({"extra": {"a": 1}}, 0)])
def test_event_errors(spark, change, n):
    df = spark.createDataFrame([(json.dumps(GOOD | change),)], "p string")
    assert len(df.select(validate.event_errors(F.col("p"))).first()[0]) == n


def test_not_json(spark):
    assert spark.createDataFrame([("{",)], "p string").select(validate.event_errors(F.col("p"))).first()[0] == ["payload: not JSON"]


def test_bank_errors(spark):
    df = spark.createDataFrame([([[1.0] * 32, [1.0] * 32],), ([[1.0] * 3],), ([[float("nan")] * 32, [1.0] * 40],), ([],)], "b array<array<double>>")
    assert [len(r[0]) for r in df.select(validate.bank_errors(F.col("b"))).collect()] == [0, 1, 2, 1]


def test_alert_lifecycle(spark):
    log = [(1, 1, "ACK", "a"), (1, 2, "ACK", "b"), (1, 3, "RESOLVED", "c"), (1, 4, "DISMISSED", "d"), (2, 1, "DISMISSED", "e"), (3, 1, "OPEN", None)]
    rows = spark.createDataFrame([(a, t * S, t, k, w, None) for a, t, k, w in log], "alert_id long, ts_us long, seq long, action string, actor string, note string")
    got = {r.alert_id: (r.status, r.acknowledged_by, r.resolved_by) for r in store.alert_lifecycle(rows).collect()}
    assert got == {1: ("RESOLVED", "a", "c"), 2: ("DISMISSED", "e", "e"), 3: ("OPEN", None, None)}


def test_reports(spark):
    live = spark.createDataFrame([], "camera_id string, zone_id string, occupancy long, status string")
    alerts = spark.createDataFrame([], "severity string")
    assert reports.summary(live, alerts).first().people_in_zones is None and reports.snapshot(live).first().total_occupancy == 0
    points = spark.createDataFrame([("a", 2, 1.0), ("a", 1, float("nan")), ("a", 0, 5.0)], "d string, l int, v double")
    assert tuple(reports.chart(points, "l", "d", "v").first()) == ("a", [0, 2], [5.0, 1.0])


def states(n=60):
    rng = np.random.default_rng(1)
    return pd.DataFrame({"seq": range(n), "ts_us": [(1000 + int(i) * 7) * S for i in range(n)], "camera_id": [f"C{i % 2}" for i in range(n)], "zone_id": ["Z"] * n, "occupancy": rng.integers(0, 3, n), "density": rng.random(n) * 5, "capacity_pct": rng.random(n) * 100, "status": ["NORMAL"] * n})


@pytest.mark.parametrize("files", [1, 4])
def test_streams_equal_batch(spark, tmp_path, files):
    """Also over several micro-batches, one file each, in order of time."""
    whole = states()
    for k, part in enumerate(np.array_split(whole, files)):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = lambda df, key: sorted(tuple(r[c] for c in key) for r in df.collect())
    key = ["camera_id", "seq", "ts_us"]
    gated = streaming.finish(lambda end: streaming.write_gate(stream(), 30 * S, closing=end), spark, str(tmp_path / "g"))
    assert rows(gated, key) == rows(folds.gated(stored, 30 * S), key)
    alert = ["camera_id", "seq", "rule_id", "kind"]
    alerts = streaming.finish(lambda end: streaming.zone_alerts(stream(), 0, closing=end), spark, str(tmp_path / "a"))
    assert rows(alerts, alert) == rows(folds.zone_alerts(stored, 0), alert)
    windows = streaming.drain(streaming.windowed(stream(), "1 minute"), str(tmp_path / "w"))
    assert {(r.camera_id, r.window_us, r.occupancy) for r in windows.collect()} <= {(r.camera_id, r.window_us, r.occupancy) for r in tracks.last_in_window(stored, "1 minute").collect()}


def test_flagship_plan_has_no_product_or_python(spark):
    plan = queries.QUERIES["time_weighted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "Pandas" not in plan


def test_sampler(spark):
    rows = spark.createDataFrame([("C", int(t * S), k, i) for i, (t, k) in enumerate([(0, 1), (0, 2), (0, 3), (0.5, 1), (1, 1), (1, 3), (2, 1)])], "camera_id string, ts_us long, track_id long, seq long")
    got = sorted((r.ts_us / S, r.track_id, r.sample) for r in tracks.sampled(rows, S, 2, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 1), (1, 1, 2), (1, 3, 1)]


def test_config(spark):
    from zonelake.sources import config

    square = [[0, 0], [1, 0], [1, 1]]
    cameras = [{"camera_id": "C", "width": 200, "height": 100, "zones": [{"zone_id": "A", "zone_type": "restricted", "normalized_polygon": square}, {"zone_id": "B", "restricted": True, "polygon": square}, {"zone_id": "D", "capacity_max": 5}]}]
    got = {r.zone_id: r for r in config.zones(spark, cameras).collect()}
    assert got["A"].restricted and got["B"].zone_type == "RESTRICTED" and not got["D"].restricted and got["D"].capacity_max == 5
    assert [tuple(p) for p in got["A"].polygon] == [(0, 0), (200, 0), (200, 100)]
    assert {tuple(r) for r in config.topology(spark, [("b", "a")], [("c", "a", 1, 2)]).collect()} == {("a", "b", "OVERLAP", 0, 120 * S), ("a", "c", "TRANSIT", S, 2 * S)}
    with pytest.raises(ValueError):
        config.topology(spark, [], [("a", "b", 5, 1)])


def test_tables(spark, tmp_path):
    from zonelake.sources import tables

    rows = spark.createDataFrame([("C1", 1.0), ("C2", 90_000.0)], "camera_id string, ts double")
    tables.write_by_day(rows, str(tmp_path / "d"))
    assert sorted(p.name for p in (tmp_path / "d").glob("dt=*")) == ["dt=1970-01-01", "dt=1970-01-02"]
    assert tables.read(spark, str(tmp_path / "d"), "zone_state").where("zone_id is null").count() == 2
    assert tables.copy(rows, str(tmp_path / "c")) == 2
    with pytest.raises(ValueError):
        tables.copy(rows, str(tmp_path / "c"), known=3)
    cameras = spark.createDataFrame([("C", "rtsp://u:p@h", "rtsp://u:p@h")], "camera_id string, stream_url string, source string")
    shown = tables.redact_cameras(cameras)
    assert shown.columns == ["camera_id", "stream_url"] and shown.first().stream_url == "rtsp://***:***@h"
    good, bad = validate.quarantine(spark.createDataFrame([(json.dumps(GOOD),), ("{}",)], "p string"), validate.event_errors(F.col("p")))
    assert good.count() == bad.count() == 1

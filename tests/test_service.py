"""Sinks, tools, charts, grid joins and identity lists against literal cases and plain Python."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from zonelake.functions import validate
from zonelake.operators import folds, geometry, identity, tracks
from zonelake.plans import reports, tools
from zonelake.sources import tables
from zonelake.streaming import sinks

S, HOUR = 1_000_000, 3_600_000_000


def table(spark, path, buckets=8):
    return sinks.Table(spark, str(path), "k string, n long, v string", ["k"], ["n"], buckets)


def test_upserts(spark, tmp_path):
    """Batches in order, some of them again, some late: always the last row of each key, as in a dictionary."""
    rng, t, want = random.Random(2), table(spark, tmp_path / "t"), {}
    assert t.read().count() == 0
    for number in range(6):
        rows = [(rng.choice("abcdefgh"), rng.randrange(20), f"{number}-{i}") for i in range(5)]
        rows = list({(k, n): (k, n, v) for k, n, v in rows}.values())
        rows = [r for r in rows if (r[0] not in want) or want[r[0]][0] != r[1]]  # no ties
        for _ in range(1 + number % 2):
            t.write(spark.createDataFrame(rows, "k string, n long, v string"), number)
        for k, n, v in rows:
            if k not in want or n > want[k][0]:
                want[k] = (n, v)
        assert {r.k: (r.n, r.v) for r in t.read().collect()} == want
    assert len(t.manifests.names()) == 2


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path / "t", 16)
    t.write(spark.range(400).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"), F.lit("x").alias("v")), 0)
    t.write(spark.createDataFrame([("7", 1000, "y")], "k string, n long, v string"), 1)
    written = list((Path(tmp_path) / "t/batch-1").rglob("*.parquet"))
    assert len(written) == 1 and t.read().count() == 400 and t.read().where("v = 'y'").count() == 1
    with pytest.raises(ValueError):
        table(spark, tmp_path / "t", 8).read()


def test_upsert_of_an_interrupted_batch(spark, tmp_path):
    """Files without a manifest don't count, and the batch that left them can run again."""
    t = table(spark, tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k string, n long, v string")
    t.write(rows(("a", 1, "x")), 0)
    t.write(rows(("a", 2, "y")), 1)
    t.manifests.delete("000000000001.json")
    assert [r.v for r in t.read().collect()] == ["x"]
    t.write(rows(("a", 2, "y")), 1)
    assert [r.v for r in t.read().collect()] == ["y"]
    t.write(spark.createDataFrame([], "k string, n long, v string"), 2)
    assert [r.v for r in t.read().collect()] == ["y"]


def receiver(folder, status):
    """A receiver that keeps each post as a file and answers by a file's content."""

    def post(stream, rows):
        answer = int(Path(status).read_text())
        if answer == 599:
            raise sinks.Held("no connection")
        if answer < 400:
            name = f"{stream}-{rows[0]['seq']}-{len(list(Path(folder).iterdir()))}.json"
            (Path(folder) / name).write_text(json.dumps([r["seq"] for r in rows]))
        return answer

    return post


@pytest.fixture
def posts(spark, tmp_path):
    (tmp_path / "posts").mkdir()
    (tmp_path / "status").write_text("200")
    forwarder = sinks.Forwarder(spark, str(tmp_path / "cursors"), receiver(str(tmp_path / "posts"), str(tmp_path / "status")), page=3)
    sent = lambda stream: [s for f in (tmp_path / "posts").iterdir() if f.name.startswith(stream) for s in json.loads(f.read_text())]
    return forwarder, sent, lambda x: (tmp_path / "status").write_text(str(x))


def put(spark, path, first, n):
    rows = spark.range(first, first + n).select(F.col("id").alias("seq"), (F.col("id") * S).alias("ts_us"))
    rows.coalesce(1).write.mode("append").parquet(str(path))
    return rows.schema


def test_forwarder(spark, tmp_path, posts):
    """Taken, held and taken again, refused for good; one stream's trouble isn't the other's."""
    forwarder, sent, answer = posts
    schema = put(spark, tmp_path / "events", 0, 8)
    run = lambda name: forwarder.run(name, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)), str(tmp_path / f"state-{name}"))
    assert run("events") and sorted(sent("events")) == list(range(8))
    assert forwarder.cursor("events") == {"batch": 0, "ts_us": 7 * S, "taken": 8, "refused": 0}
    put(spark, tmp_path / "events", 8, 4)
    answer(503)
    assert not run("events") and not run("events") and forwarder.cursor("events")["batch"] == 0
    answer(599)
    assert not run("events")
    answer(200)
    put(spark, tmp_path / "alerts", 100, 2)
    assert run("alerts") and sorted(sent("alerts")) == [100, 101]
    assert run("events") and sorted(set(sent("events"))) == list(range(12)) and forwarder.cursor("events")["ts_us"] == 11 * S
    put(spark, tmp_path / "events", 12, 4)
    answer(422)
    assert run("events") and forwarder.cursor("events") == {"batch": 2, "ts_us": 15 * S, "taken": 12, "refused": 4}
    answer(200)
    assert run("events") and sorted(set(sent("events"))) == list(range(12))


def test_forwarder_skips_a_recorded_batch(spark, posts):
    """The record was written and the stream's checkpoint wasn't: the batch isn't posted again."""
    forwarder, sent, _ = posts
    rows = spark.range(5).select(F.col("id").alias("seq"), F.col("id").alias("ts_us"))
    sink = forwarder.sink("events")
    sink(rows, 0)
    sink(rows, 0)
    assert sorted(sent("events")) == list(range(5))


def test_forwarder_ticks(spark, posts):
    """Pages of a table; a held page leaves the cursor, and the overlap is sent again."""
    forwarder, sent, answer = posts
    rows = spark.range(10).select(F.col("id").alias("seq"), (F.col("id") * S).alias("ts_us"))
    tick = lambda: forwarder.tick("events", rows, "seq", overlap_us=S, limit=4)
    assert tick() and sorted(sent("events")) == [0, 1, 2, 3]
    answer(500)
    assert not tick() and forwarder.cursor("events")["ts_us"] == 3 * S
    answer(200)
    assert tick() and sorted(sent("events")) == [0, 1, 2, 2, 3, 3, 4, 5]


def test_boxes_that_meet(spark):
    """Every overlapping pair once, whatever cells they span; touching edges and boxes without extent don't overlap."""
    rng = random.Random(1)
    boxes = [("C", rng.randrange(2), k, *(x, y, x + rng.choice([0.0, 5.0, 60.0, 700.0]), y + rng.choice([3.0, 200.0]))) for k, (x, y) in enumerate((rng.choice([0.0, 40.0, 159.0, 160.0, 319.5]) - 200 * (rng.random() < 0.2), rng.choice([0.0, 160.0, 161.0])) for _ in range(60))]
    df = spark.createDataFrame(boxes, "camera_id string, ts_us long, track_id long, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.track_id, r.r_track_id) for r in geometry.meeting(df, df, ["camera_id", "ts_us"]).collect())
    area = lambda a, b: (min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4]))
    assert got == sorted((a[2], b[2]) for a in boxes for b in boxes if a[1] == b[1] and min(area(a, b)) > 0)
    covered = {a[2] for a in boxes for b in boxes if a[1] == b[1] and a[2] != b[2] and min(area(a, b)) > 0 and area(a, b)[0] * area(a, b)[1] > 0.25 * (a[5] - a[3]) * (a[6] - a[4])}
    out = geometry.occluded(df)
    assert out.count() == 60 and {r.track_id for r in out.where("occluded").collect()} == covered


def test_clusters_by_numpy(spark):
    """The nearest free place within reach, means that move, more places than fit at first."""
    c = tracks.Clusters(10.0)
    assert [c.add(0, 0, 0), c.add(0, 1, 0), c.add(1, 4, 0), c.add(1, 4.1, 0), c.add(2, 100, 0)] == [0, 1, 1, 0, 2]
    assert [c.add(3, 1000.0 * k, 0) for k in range(1, 41)] == list(range(3, 43))


def test_candidates(spark):
    """By hand: overlapping cameras, a transit's window, an unknown pair, the same camera, and another site."""
    rows = [("S", "A", 1, 0, 1), ("S", "A", 1, 50, 2), ("S", "B", 2, 60, 3), ("S", "C", 3, 100, 4), ("S", "A", 4, 130, 5), ("T", "B", 5, 61, 6), ("S", "D", 6, 500, 7)]
    seen = spark.createDataFrame([(*r[:3], r[3] * S, r[4], [1.0, float(r[4])]) for r in rows], "site_id string, camera_id string, track_id long, ts_us long, seq long, vector array<double>")
    topology = spark.createDataFrame([("A", "B", "TRANSIT", 20 * S, 90 * S), ("B", "C", "OVERLAP", 0, 30 * S)], "a string, b string, kind string, min_us long, max_us long")
    got = {(r.from_seq, r.to_seq): r.reason for r in identity.candidates(seen, topology).collect()}
    assert got == {(1, 3): "transit_ok", (1, 4): "unknown_pair", (2, 4): "unknown_pair", (1, 5): "same_camera", (2, 5): "same_camera", (3, 5): "transit_ok", (4, 5): "unknown_pair"}


def test_identity_lists(spark):
    rows = spark.createDataFrame([("S", c, g, t, t) for c, g, t in (("A", "p", 1), ("A", "p", 2), ("B", "p", 3), ("A", "p", 4), ("B", "q", 5))], "site_id string, camera_id string, global_ref string, ts_us long, seq long")
    assert sorted(tuple(r)[1:] for r in identity.journey(rows).collect()) == [("p", "A", 1, 2, 2), ("p", "A", 4, 4, 1), ("p", "B", 3, 3, 1), ("q", "B", 5, 5, 1)]
    assert [r.global_ref for r in identity.listing(rows, True).collect()] == ["p"]
    one = identity.merged(rows, spark.createDataFrame([("p", "q"), ("p", "p")], "keep string, drop string"))
    assert {r.global_ref for r in one.collect()} == {"p"} and one.columns == rows.columns


def test_gates_by_mode_and_scene(spark):
    rows = spark.createDataFrame([("C", "Z", k, k, 1, 1.0, 1.0, s, scene) for k, (s, scene) in enumerate([("N", 0), ("N", 0), ("W", 0), ("W", 1), ("W", 1)])], f"{', '.join(x for x in ('camera_id string', 'zone_id string', 'seq long', 'ts_us long', 'occupancy long', 'density double', 'capacity_pct double', 'status string'))}, scene long")
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(folds.density_updates(rows)) == [0, 2] and seqs(folds.density_updates(rows, " Always")) == [0, 1, 2, 3, 4] and seqs(folds.density_updates(rows, "off")) == []
    assert seqs(folds.density_updates(rows, "no such mode", "scene")) == [0, 2, 3]
    assert seqs(folds.gated(rows, 0, "scene")) == seqs(folds.gated(rows, 10, "scene")) == [0, 2, 3]


def test_charts(spark):
    rows = spark.createDataFrame([("a", 1, 1.5), ("a", 2, float("nan")), ("b", 2, 3.0), ("b", 3, None)], "d string, l long, v double")
    assert sorted((r.dataset, r.labels, r.data) for r in reports.shared_charts(rows, "l", "d", "v").collect()) == [("a", [1, 2, 3], [1.5, None, None]), ("b", [1, 2, 3], [None, 3.0, None])]
    many = spark.range(3000).select((F.col("id") % 20).cast("string").alias("d"), F.floor(F.col("id") / 2).alias("l"), F.col("id").alias("v"))
    shown = reports.shared_charts(many, "l", "d", "v").collect()
    assert len(shown) == 8 and {len(r.labels) for r in shown} == {len(r.data) for r in shown} == {1000}
    points = spark.createDataFrame([("C", "Z", 0, 1.0, 2.3461, 4), ("C", "Z", 10, 0.0, None, 0), ("C", "Y", 0, 0.0, None, 0)], "camera_id string, zone_id string, bucket_us long, coverage double, occupancy double, peak_occupancy long")
    got = sorted((r.zone_id, r.chart, r.dataset, r.labels, r.data, r.value) for r in reports.series_charts(points).collect())
    assert got == [("Z", "coverage", None, None, None, 50.0), ("Z", "occupancy", "mean", [0, 10], [2.35, None], None), ("Z", "occupancy", "peak", [0, 10], [4.0, 0.0], None)]


def test_tools(spark):
    state = lambda cam, zone, h, occ: (int(h), cam, zone, int(h * HOUR), occ, float(occ), 1.0 * occ, "CRITICAL" if occ > 5 else "NORMAL")
    states = spark.createDataFrame([state("C", "Z", 1, 9), state("C", "Z", 3, 1), state("D", "Z", 4, 2), state("C", "Y", 2, 3)], "seq long, camera_id string, zone_id string, ts_us long, occupancy long, density double, capacity_pct double, status string")
    events = spark.createDataFrame([("C", 4 * HOUR, 1, "CAMERA_OFFLINE")], "camera_id string, ts_us long, seq long, event_type string")
    zones = states.select("camera_id", "zone_id", F.lit("n").alias("zone_name")).distinct()
    alerts = states.select(F.col("seq").alias("alert_id"), "seq", "ts_us", "camera_id", "zone_id", F.lit("OPEN").alias("status"), F.lit("RED").alias("severity"), F.lit("R-01").alias("rule_id"))
    site = tools.Site(states, events, alerts, zones, 2 * HOUR)
    run = lambda name, **args: tools.run(site, name, args, 5 * HOUR)
    for name, args in (("nothing", {}), ("alerts", {"colour": "red"}), ("zone_at_time", {}), ("zone_at_time", {"zone_id": "Z"}), ("zone_duration", {"zone_id": "Y", "field": "occupancy", "op": "like", "value": 1})):
        with pytest.raises(ValueError):
            run(name, **args)
    with pytest.raises(LookupError):
        run("zone_at_time", zone_id="X")
    both = run("zone_duration", zone_id="Z", camera_id="C", status="critical", field="occupancy", op="gte", value=0).first()
    assert both.total_us == 2 * HOUR  # the status is meant
    now = run("zone_at_time", zone_id="Z", camera_id="C", ts=None).first()
    assert (now.state.occupancy, now.stale, now.camera_offline, now.trustworthy) == (1, False, True, False)
    assert run("live_state").count() == 0 and run("alerts", hours=1.5, camera_id="d").count() == 1 and run("alerts", limit=2).count() == 2
    assert run("alerts", **{"from": 1 * HOUR, "to": 2 * HOUR}).count() == 2
    assert run("zone_history", zone_id="Y", hours=4, bucket=HOUR).count() == 4
    assert {r.camera_id for r in run("occupancy_report", camera_id="C").collect()} == {"C"}


def test_tuning_messages(spark):
    cases = {
        "[]": ["payload must be an object"], "not json": ["payload must be an object"], "{}": ["nothing to change: send threshold, margin or ttl_seconds"], '{"other": 1}': ["nothing to change: send threshold, margin or ttl_seconds"],
        '{"threshold": "0.5"}': [], '{"threshold": true}': [], '{"threshold": false}': ["threshold must be a number in (0, 1] and finite"], '{"threshold": null}': ["threshold must be a number in (0, 1]"], '{"threshold": [1]}': ["threshold must be a number in (0, 1]"],
        '{"margin": "Infinity", "ttl_seconds": "x"}': ["margin must be a number >= 0 and finite", "ttl_seconds must be a number > 0"], '{"margin": -1, "threshold": 1}': ["margin must be a number >= 0 and finite"], '{"ttl_seconds": 1e400}': ["ttl_seconds must be a number > 0 and finite"],
        '{"ttl_seconds": "true"}': ["ttl_seconds must be a number > 0"], '{"margin": " 2 "}': [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.e for r in df.select("p", validate.tuning_errors(F.col("p")).alias("e")).collect()} == cases


def test_copy_by_common_columns(spark, tmp_path):
    source = spark.createDataFrame([(1, "a", 2.0)], "id int, name string, extra double")
    target = spark.createDataFrame([], "name string, id long, more string")
    assert tables.copy(source, str(tmp_path / "t"), target=target) == 1
    assert spark.read.parquet(str(tmp_path / "t")).first().asDict() == {"name": "a", "id": 1, "more": None}
    with pytest.raises(ValueError):
        tables.copy(source.limit(0), str(tmp_path / "t"), target=source)
    with pytest.raises(ValueError):
        tables.copy(source, str(tmp_path / "t"), target=spark.createDataFrame([], "x int"))


def test_backend(spark, tmp_path):
    spark.createDataFrame([("C", "ONLINE")], "camera_id string, state string").write.parquet(str(tmp_path / "cameras"))
    assert tables.backend(spark, {"ZONELAKE_WAREHOUSE": str(tmp_path)})("cameras").first().state == "ONLINE"
    spark.range(3).createOrReplaceTempView("events")
    assert tables.backend(spark, {"ZONELAKE_INMEMORY": "1"})("events").count() == 3

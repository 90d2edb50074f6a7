"""Scheduled reports, names of zones, databases and files by day against literal cases and plain Python."""

import random

from pyspark.sql import functions as F

from zonelake.functions import validate
from zonelake.operators import store
from zonelake.plans import reports
from zonelake.sources import tables

S, DAY = 1_000_000, 86_400_000_000


def polled(requests: list[int], t0: int, t1: int, every: int) -> list[tuple]:
    """What a scheduler that looks at every moment makes."""
    out, last = [], None
    for t in range(t0, t1 + 1):
        if t in requests:
            out.append((t, "on_demand"))
            last = t
        elif last is None or t - last >= every:
            out.append((t, "scheduled"))
            last = t
    return out


def test_schedule_equals_polling(spark):
    rng = random.Random(4)
    asked = {c: sorted(rng.choices(range(-5, 70), k=rng.randrange(9))) for c in "ABCDEF"} | {"G": [0], "H": [60, 60], "I": []}
    rows = spark.createDataFrame([(c, t) for c, times in asked.items() for t in times] + [("A", None)], "camera_id string, ts_us long")
    found = reports.schedule(rows, spark.createDataFrame([(c,) for c in asked], "camera_id string"), 0, 60, 7).collect()
    for c, times in asked.items():
        assert sorted((r.at_us, r.trigger) for r in found if r.camera_id == c) == polled(times, 0, 60, 7)


def test_snapshots(spark):
    readings = spark.createDataFrame([(1, 10, "A", "Z1", 3), (2, 20, "A", "Z2", 5), (3, DAY + 5, "A", "Z1", 0), (4, DAY + 5, "A", "Z1", 1)], "seq long, ts_us long, camera_id string, zone_id string, occupancy long")
    instants = spark.createDataFrame([("A", t, "scheduled") for t in (5, 10, 20, DAY, DAY + 5, 3 * DAY)] + [("B", 20, "on_demand")], "camera_id string, at_us long, trigger string")
    found = {(r.camera_id, r.at_us): (r.zones, r.total_occupancy, r.peak_occupancy) for r in reports.snapshots(instants, readings).collect()}
    assert found == {("A", 5): (0, 0, 0), ("A", 10): (1, 3, 3), ("A", 20): (2, 8, 5), ("A", DAY): (2, 8, 5), ("A", DAY + 5): (2, 6, 5), ("A", 3 * DAY): (2, 6, 5), ("B", 20): (0, 0, 0)}
    assert reports.snapshots(instants.limit(0), readings).count() == 0 and reports.snapshots(instants, readings.limit(0)).count() == 7


def test_resolved_zones(spark):
    key = "camera_id string, zone_id string"
    configured = spark.createDataFrame([("A", "Z1"), ("A", "Z2"), (None, "Z2"), ("A", "Z4")], key)
    history = spark.createDataFrame([("B", "Z1"), ("A", "Z2"), ("A", "Z2"), ("B", "Z3")], key)
    asked = [("Z1", None), ("Z1", "B"), ("Z2", None), ("Z3", None), ("Z3", "A"), ("Z9", None), (None, None), ("Z2", None)]
    want = [(None, 2, "ambiguous"), ("B", 1, "found"), ("A", 1, "found"), ("B", 1, "found"), (None, 0, "unknown"), (None, 0, "unknown"), (None, 0, "unknown"), ("A", 1, "found")]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, zone_id string, camera_id string")
    assert [tuple(r)[3:] for r in store.resolve_zones(rows, configured, history).orderBy("i").collect()] == want


def test_zones_of_an_editor(spark):
    kinds = "zone_id string, zone_type string, polygon array<int>, capacity_max long, area_sqm double, warning_density double, critical_density double"
    rows = [("Z", None, [1, 2, 3], None, None, None, None), ("", "monitored", None, 0, 0.0, -1.0, -0.5)]
    found = [r[0] for r in spark.createDataFrame(rows, kinds).select(validate.zone_errors()).collect()]
    assert found == [[], ["zone_id: missing", "polygon: fewer than three points", "warning_density: negative", "critical_density: negative"]]


def test_database_in_ranges(spark):
    """A table written to a database of this process and read again in four ranges, with the filter done there."""
    url = "jdbc:derby:memory:zonelake;create=true"
    spark.range(100).select(F.col("id").alias("SEQ"), (F.col("id") % 7).alias("OCCUPANCY")).coalesce(1).write.format("jdbc").options(url=url, dbtable="STATES").mode("overwrite").save()
    rows = tables.read_jdbc(spark, url, "STATES", "SEQ", 0, 100, 4)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 100
    few = rows.where("OCCUPANCY = 3")
    assert sorted(r.SEQ for r in few.collect()) == list(range(3, 100, 7))
    assert "EqualTo(OCCUPANCY" in few._jdf.queryExecution().toString()
    read = tables.backend(spark, {"ZONELAKE_DATABASE_URL": url})
    assert read("STATES").agg(F.sum("SEQ")).first()[0] == 4950


def test_days_are_pruned(spark, tmp_path):
    rows = spark.range(10).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("camera_id"), (F.col("id") * 43_200.0).alias("ts"), F.lit(1).cast("long").alias("occupancy"))
    tables.write_by_day(rows, str(tmp_path / "s"))
    read = spark.read.schema(f"{tables.STATE_ROW}, dt string").parquet(str(tmp_path / "s")).where("dt = '1970-01-02'")
    assert sorted(r.ts for r in read.collect()) == [86_400.0, 129_600.0] and read.first().trend is None
    assert "PartitionFilters: [isnotnull(dt" in read._jdf.queryExecution().toString()


def test_urls_of_cameras(spark):
    cameras = spark.createDataFrame([("C", "rtsp://u:p@h/a", "rtsp://k@h/b", "rtsp://u:p@h/c")], "camera_id string, stream_url string, rtsp_url string, source string")
    assert tuple(tables.redact_cameras(cameras).first()) == ("C", "rtsp://***:***@h/a", "rtsp://***@h/b")
    assert tables.redact_cameras(cameras, keep_source=True).first().source == "rtsp://***:***@h/c"

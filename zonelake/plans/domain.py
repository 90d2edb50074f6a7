"""The domain's tables, derived from the generic ``events`` table, and small fixed dimensions.

Twelve zones: every camera (CAM-00 to CAM-03) has ZONE-00 to ZONE-02, so a zone is known only with its camera.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A week, and how long a reading may stand for, in microseconds.
SECOND = 1_000_000
T0, T1 = 1_704_412_800 * SECOND, 1_705_017_600 * SECOND
MAX_HOLD = 7_200 * SECOND
KEY = ["camera_id", "zone_id"]


def events(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """(seq, ts_us, user_id, event_type, value, camera_id, zone_id), from the table or a stream of its rows."""
    return (spark.read.parquet(f"{sf_dir}/events.parquet") if raw is None else raw).select(
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value",
        F.concat(F.lit("CAM-0"), (F.col("user_id") % 4).cast("string")).alias("camera_id"),
        F.concat(F.lit("ZONE-0"), (F.floor(F.col("user_id") / 4) % 3).cast("string")).alias("zone_id"),
    )


def zones(spark: SparkSession) -> DataFrame:
    """The zone dimension, with a square polygon for each zone side by side in a 300 x 100 frame."""
    cell = spark.range(12).select((F.col("id") % 4).alias("c"), F.floor(F.col("id") / 4).alias("z"))
    x = F.col("z") * 100.0
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), F.lit(dy).cast("double").alias("y"))
    return cell.select(
        F.concat(F.lit("CAM-0"), F.col("c").cast("string")).alias("camera_id"), F.concat(F.lit("ZONE-0"), F.col("z").cast("string")).alias("zone_id"),
        F.concat(F.lit("Area "), F.col("c").cast("string"), F.lit("-"), F.col("z").cast("string")).alias("zone_name"),
        F.when(F.col("z") == 2, "RESTRICTED").otherwise("MONITORED").alias("zone_type"), (F.col("z") == 2).alias("restricted"),
        (F.col("c") * 2 + 6).cast("long").alias("capacity_max"), (F.col("z") + 2).cast("double").alias("area_sqm"),
        F.lit(2.0).alias("warning_density"), F.lit(4.0).alias("critical_density"),
        F.array(corner(0.0, 0), corner(100.0, 0), corner(100.0, 100), corner(0.0, 100)).alias("polygon"),
    )


def states(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """Zone readings: occupancy with what follows from the zone's area and capacity."""
    from zonelake.functions.scalars import capacity_pct, density, density_status

    rows = events(spark, sf_dir, raw).where(F.col("event_type").isin("view", "click", "purchase"))
    rows = rows.select("seq", "ts_us", *KEY, (F.floor("value") % 12).cast("long").alias("occupancy"))
    rows = rows.join(F.broadcast(zones(spark).select(*KEY, "area_sqm", "capacity_max", "warning_density", "critical_density")), KEY)
    rows = rows.withColumn("density", density(F.col("occupancy"), F.col("area_sqm"))).withColumn("capacity_pct", capacity_pct(F.col("occupancy"), F.col("capacity_max")))
    rows = rows.withColumn("status", density_status(F.col("density"), F.col("warning_density"), F.col("critical_density")))
    return rows.select("seq", "ts_us", *KEY, "occupancy", "density", "capacity_pct", "status")


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAMERA_OFFLINE and CAMERA_ONLINE events."""
    rows = events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    return rows.select("seq", "ts_us", "camera_id", F.when(F.col("event_type") == "error", "CAMERA_OFFLINE").otherwise("CAMERA_ONLINE").alias("event_type"))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone entries, exits and transitions; a transition leads to the next zone of the camera."""
    from zonelake.functions.identity import person_ref

    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click", "purchase"))
    following = F.concat(F.lit("ZONE-0"), ((F.floor(F.col("user_id") / 4) + 1) % 3).cast("string"))
    kind = F.when(F.col("event_type") == "click", "ZONE_ENTRY").when(F.col("event_type") == "purchase", "ZONE_EXIT").otherwise("ZONE_TRANSITION")
    return rows.select(
        "seq", "ts_us", "camera_id", kind.alias("event_type"),
        F.when(kind != "ZONE_ENTRY", F.col("zone_id")).alias("zone_from"),
        F.when(kind == "ZONE_ENTRY", F.col("zone_id")).when(kind == "ZONE_TRANSITION", following).alias("zone_to"),
        person_ref(F.lit("salt"), F.col("user_id")).alias("person_ref"),
    )


# The same tables for DuckDB, as common table expressions.
SQL_EVENTS = """ev AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id, event_type, value,
  'CAM-0' || (user_id % 4) AS camera_id, 'ZONE-0' || ((user_id // 4) % 3) AS zone_id FROM events)"""
SQL_ZONES = """zn AS (SELECT 'CAM-0' || (i % 4) AS camera_id, 'ZONE-0' || (i // 4) AS zone_id, 'Area ' || (i % 4) || '-' || (i // 4) AS zone_name,
  CASE WHEN i // 4 = 2 THEN 'RESTRICTED' ELSE 'MONITORED' END AS zone_type, i // 4 = 2 AS restricted,
  CAST(i % 4 * 2 + 6 AS BIGINT) AS capacity_max, CAST(i // 4 + 2 AS DOUBLE) AS area_sqm FROM (SELECT unnest(range(12)) AS i))"""
SQL_STATES = f"""{SQL_EVENTS}, {SQL_ZONES}, st0 AS (SELECT seq, ts_us, ev.camera_id, ev.zone_id, CAST(floor(value) AS BIGINT) % 12 AS occupancy, area_sqm, capacity_max
  FROM ev JOIN zn ON ev.camera_id = zn.camera_id AND ev.zone_id = zn.zone_id WHERE event_type IN ('view', 'click', 'purchase')),
st AS (SELECT seq, ts_us, camera_id, zone_id, occupancy, occupancy / area_sqm AS density, 100.0 * occupancy / capacity_max AS capacity_pct,
  CASE WHEN occupancy / area_sqm > 4.0 THEN 'CRITICAL' WHEN occupancy / area_sqm > 2.0 THEN 'WARNING' ELSE 'NORMAL' END AS status FROM st0)"""
SQL_CAMERA = """ce AS (SELECT seq, ts_us, camera_id, CASE event_type WHEN 'error' THEN 'CAMERA_OFFLINE' ELSE 'CAMERA_ONLINE' END AS event_type FROM ev WHERE event_type IN ('error', 'signup'))"""
SQL_MOVES = """mv AS (SELECT seq, ts_us, camera_id, CASE event_type WHEN 'click' THEN 'ZONE_ENTRY' WHEN 'purchase' THEN 'ZONE_EXIT' ELSE 'ZONE_TRANSITION' END AS event_type,
  CASE WHEN event_type <> 'click' THEN zone_id END AS zone_from,
  CASE event_type WHEN 'click' THEN zone_id WHEN 'view' THEN 'ZONE-0' || ((user_id // 4 + 1) % 3) END AS zone_to,
  'pr_' || substr(sha256('salt:' || user_id), 1, 16) AS person_ref FROM ev WHERE event_type IN ('view', 'click', 'purchase'))"""

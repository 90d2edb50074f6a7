"""The relational views over readings, live rows, events and alerts; none of them shows a camera's source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelake.operators import intervals as iv
from zonelake.operators.series import latest

KEY = ["camera_id", "zone_id"]
ZONE = ["zone_name", "zone_type", "restricted", "capacity_max", "area_sqm"]


def with_zone(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Left join with the zone dimension, some columns wide and one row per zone of the site."""
    return rows.join(F.broadcast(zones.select(*KEY, *ZONE)), KEY, "left")


def zone_intervals(states: DataFrame, zones: DataFrame, stale_us: int = 600_000_000) -> DataFrame:
    """Every reading with the time from which to which it is valid; the newest is open and never stale."""
    held = iv.hold_forward(states, KEY)
    duration = F.col("next_us") - F.col("ts_us")
    out = held.select(
        *KEY, "seq", F.col("ts_us").alias("valid_from_us"), F.col("next_us").alias("valid_to_us"), duration.alias("duration_us"),
        F.coalesce(duration > stale_us, F.lit(False)).alias("is_stale"), F.col("next_us").isNull().alias("is_open"), "occupancy", "density", "capacity_pct", "status",
    )
    return with_zone(out, zones)


def zone_current(states: DataFrame, zones: DataFrame) -> DataFrame:
    return with_zone(latest(states), zones)


def zone_events(movements: DataFrame, zones: DataFrame) -> DataFrame:
    """Movement events with the zone that they concern: the one entered, else the one left."""
    return with_zone(movements.withColumn("zone_id", F.coalesce("zone_to", "zone_from")), zones)


def alerts_view(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    return with_zone(alerts, zones)


def timeline(states: DataFrame, movements: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per fact: a union, as a join of the three would multiply them."""
    a = states.select(F.lit("state").alias("record_type"), "ts_us", *KEY, F.col("status").alias("detail"), "occupancy")
    b = movements.select(F.lit("event").alias("record_type"), "ts_us", "camera_id", F.coalesce("zone_to", "zone_from").alias("zone_id"), F.col("event_type").alias("detail"))
    c = alerts.select(F.lit("alert").alias("record_type"), "ts_us", *KEY, F.col("rule_id").alias("detail"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def register(spark, **views: DataFrame) -> None:
    for name, view in views.items():
        view.createOrReplaceTempView(f"v_{name}")

"""What the store does: idempotent inserts, live rows, partial updates, filters, retention and pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonelake.operators import intervals as iv
from zonelake.operators.series import KEY, latest, winners


def last_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one that arrived last by one or two whole numbers; its place is aggregated before the shuffle, without a
    sort."""
    return winners(rows, key, order)


def live_rows(states: DataFrame) -> DataFrame:
    """The live row of each zone; a late row never moves it back, one of equal time does."""
    return latest(states)


def partial_upsert(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Per key the last value of each field that isn't null."""
    place = F.struct(*order)
    return rows.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields])


def last_seen(*tables: DataFrame) -> DataFrame:
    """Liveness of cameras from everything that they sent."""
    out = tables[0].select("camera_id", "ts_us")
    for t in tables[1:]:
        out = out.union(t.select("camera_id", "ts_us"))
    return out.groupBy("camera_id").agg(F.max("ts_us").alias("last_seen_us"))


def replace_set(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Rows of owners that appear in new are replaced as a set."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def retain(rows: DataFrame, cutoff_us: int) -> DataFrame:
    return rows.where(F.col("ts_us") >= cutoff_us)


def retain_days(spark: SparkSession, path: str, cutoff_us: int) -> list[str]:
    """Retention of a table that write_by_day() made: whole days before the cutoff's go, by partition. Gives these days.

    Alerts aren't kept by day and so are spared; they go by delete_alerts().
    """
    cutoff = spark.sql(f"SELECT date_format(timestamp_micros({int(cutoff_us)}), 'yyyy-MM-dd')").first()[0]
    days = sorted(str(r[0]) for r in spark.read.parquet(path).select("dt").distinct().collect())
    gone = [day for day in days if day < cutoff]
    for day in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def delete_alerts(alerts: DataFrame, scope: str = "closed") -> tuple[DataFrame, DataFrame]:
    """Alerts that stay when closed ones (or ``all``) go, and the frames (frame) of those that went, which go with them."""
    if scope not in ("closed", "all"):
        raise ValueError(f"scope is closed or all, not {scope}")
    gone = F.lit(True) if scope == "all" else F.coalesce(F.col("status").isin("RESOLVED", "DISMISSED"), F.lit(False))
    return alerts.where(~gone), alerts.where(gone & F.col("frame").isNotNull()).select("frame")


def merge_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cursors (name, ts_us): those in new replace those of the same name, whether they lie before or after."""
    return replace_set(old, new, "name")


def page(rows: DataFrame, n: int, offset: int = 0, order: tuple[str, ...] = ("ts_us", "seq")) -> DataFrame:
    """A page of the newest rows, with ``has_more`` if others follow."""
    taken = newest(rows, n + 1, offset, order)
    place = Window.orderBy(*[F.desc(c) for c in order])  # over one row more than a page
    return taken.withColumn("__place", F.row_number().over(place)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > n).where(F.col("__place") <= n).drop("__place")


def changes(states: DataFrame, field: str = "occupancy", keys: list[str] = KEY) -> DataFrame:
    """Readings at which a field differs from the one before, with that one (previous) and until when it held."""
    held = iv.hold_forward(iv.previous(states, keys, field, "previous"), keys, into="held_until_us")
    return held.where(F.col("previous").isNotNull() & (F.col(field) != F.col("previous")))


def in_range(rows: DataFrame, t0: int, t1: int, **equal: str | None) -> DataFrame:
    """Rows of [t0, t1] that equal every given value; None asks for nothing."""
    found = rows.where(F.col("ts_us").between(t0, t1))
    for name, value in equal.items():
        found = found if value is None else found.where(F.col(name) == value)
    return found


def touching_zone(movements: DataFrame, zone: str) -> DataFrame:
    zones = [c for c in ("zone_id", "zone_from", "zone_to") if c in movements.columns]
    return movements.where(F.lit(zone).isin(*[F.col(c) for c in zones]))


def newest(rows: DataFrame, n: int, offset: int = 0, order: tuple[str, ...] = ("ts_us", "seq")) -> DataFrame:
    """A page of the newest rows; a top-k, not a full sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).offset(offset).limit(n)


def fresh(live: DataFrame, now_us: int, limit_us: int = 30_000_000) -> DataFrame:
    return live.where(F.col("ts_us") >= now_us - limit_us)


def active_alerts(alerts: DataFrame, open_only: bool = False) -> DataFrame:
    status = F.coalesce("status", F.lit("OPEN"))
    found = alerts.where((F.col("kind") != "CLEAR") & ~status.isin("RESOLVED", "DISMISSED"))
    return found.where(status == "OPEN") if open_only else found


def matching(alerts: DataFrame, **equal: str | None) -> DataFrame:
    """Alerts whose fields equal the given values in any case."""
    for name, value in equal.items():
        alerts = alerts if value is None else alerts.where(F.upper(name) == value.upper())
    return alerts


def payload_fills(rows: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """Columns that are null take the value of the payload's key; others stay."""
    keys = F.from_json(payload, "map<string,string>")
    return rows.select(*[F.coalesce(F.col(c), keys[c].cast(rows.schema[c].dataType)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def stats(states: DataFrame, t0: int, t1: int) -> DataFrame:
    """Plain statistics of the rows in a window, each row with the same weight."""
    rows = states.where(F.col("ts_us").between(t0, t1))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("samples"), F.avg("occupancy").alias("avg_occupancy"), F.avg("density").alias("avg_density"), F.avg("capacity_pct").alias("avg_capacity_pct"),
        F.max("occupancy").alias("peak_occupancy"), F.max("density").alias("peak_density"),
    )


def resolve_zone(configured: DataFrame, history: DataFrame, zone: str, camera: str | None = None) -> tuple[str, str]:
    """The one (camera, zone) of that name; LookupError if there is none, ValueError with the cameras if there are more."""
    keys = configured.select(*KEY).union(history.select(*KEY)).where(F.col("zone_id") == zone)
    keys = keys if camera is None else keys.where(F.col("camera_id") == camera)
    found = sorted((r.camera_id, r.zone_id) for r in keys.distinct().limit(100).collect())
    if not found:
        raise LookupError(zone)
    if len(found) > 1:
        raise ValueError(f"{zone} exists on {', '.join(c for c, _ in found)}")
    return found[0]


def resolve_zones(asked: DataFrame, configured: DataFrame, history: DataFrame) -> DataFrame:
    """Adds to asked zones (zone_id, camera_id or null, ...) the camera that is meant (camera), on how many cameras the name exists
    among those asked for (candidates), and found, ambiguous or unknown.

    Both what is configured and what only has history counts, so a name is never taken for the wrong place. These keys are counted before
    the join, so it has one row a name and one a key, as many as a deployment has zones, however many rows history has.
    """
    keys = configured.select(*KEY).union(history.select(*KEY)).dropna().distinct()
    named = keys.groupBy(F.col("zone_id").alias("__zone")).agg(F.count("*").alias("__n"), F.min("camera_id").alias("__first"))
    exact = keys.select(F.col("zone_id").alias("__z"), F.col("camera_id").alias("__c"))
    met = asked.join(named, F.col("zone_id") == F.col("__zone"), "left").join(exact, (F.col("zone_id") == F.col("__z")) & (F.col("camera_id") == F.col("__c")), "left")
    n = F.when(F.col("camera_id").isNull(), F.coalesce("__n", F.lit(0))).otherwise(F.col("__c").isNotNull().cast("long"))
    camera = F.when(n == 1, F.coalesce("camera_id", "__first"))
    status = F.when(n == 0, "unknown").when(n == 1, "found").otherwise("ambiguous")
    return met.select(*asked.columns, camera.alias("camera"), n.alias("candidates"), status.alias("resolution"))


def alert_lifecycle(actions: DataFrame) -> DataFrame:
    """Folds a log (alert_id, ts_us, seq, action, actor, note) into one row per alert.

    OPEN goes to ACK, RESOLVED or DISMISSED and ACK to the latter two, which are final. So the first final action
    decides, and an acknowledgement counts if it comes before; resolving an alert also acknowledges it.
    """
    first = Window.partitionBy("alert_id").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    final = F.col("action").isin("RESOLVED", "DISMISSED")
    open_yet = F.coalesce(F.max(final.cast("int")).over(first), F.lit(0)) == 0
    acked_yet = F.coalesce(F.max((F.col("action") == "ACK").cast("int")).over(first), F.lit(0)) == 1
    valid = actions.withColumn("__ok", open_yet & (final | ~acked_yet)).where("__ok").drop("__ok")
    order = F.struct("ts_us", "seq")
    pick = lambda c, when: F.min_by(c, F.when(when, order))
    any_ack = F.col("action").isin("ACK", "RESOLVED", "DISMISSED")
    return valid.groupBy("alert_id").agg(
        F.max_by("action", order).alias("status"), pick("actor", any_ack).alias("acknowledged_by"), pick("ts_us", any_ack).alias("acknowledged_us"),
        pick("actor", final).alias("resolved_by"), pick("ts_us", final).alias("resolved_us"), F.max_by("note", F.when(F.col("note").isNotNull(), order)).alias("note"),
    )


def to_json(row: dict) -> str:
    return json.dumps(row, sort_keys=True, ensure_ascii=False)


def utc(ts_us: Column) -> Column:
    return F.timestamp_micros(ts_us)


def tail(rows: DataFrame, cursor_us: int, key: str, overlap_us: int = 2_000_000, limit: int = 500) -> DataFrame:
    """The next page of a durable tail: oldest first from a little before the cursor, each key once. Whoever consumes it
    moves the cursor to the last time of the page and ignores keys that it has had."""
    fresh_rows = last_write_wins(rows.where(F.col("ts_us") >= cursor_us - overlap_us), [key], ["ts_us", "seq"])
    return fresh_rows.orderBy("ts_us", "seq").limit(limit)


def spread(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON column overwrite the row's, where the JSON has them."""
    keys = F.from_json(column, "map<string,string>")
    out = rows.withColumn("__keys", keys)
    for name, kind in fields.items():
        value = F.col("__keys")[name].cast(kind)
        out = out.withColumn(name, F.coalesce(value, F.col(name)) if name in rows.columns else value)
    return out.drop("__keys", column)


def join_cost(states: DataFrame, movements: DataFrame, alerts: DataFrame, key: list[str] = KEY) -> DataFrame:
    """How many rows a join of the three facts by zone would make; counted, not joined."""
    n = lambda rows, name: rows.groupBy(*key).agg(F.count("*").alias(name))
    both = n(states, "n_states").join(n(movements, "n_events"), key, "left").join(n(alerts, "n_alerts"), key, "left").fillna(1, ["n_events", "n_alerts"])
    return both.agg(F.sum(F.col("n_states") * F.greatest("n_events", F.lit(1)) * F.greatest("n_alerts", F.lit(1))).alias("joined_rows"), F.sum("n_states").alias("state_rows"))


def near_in_time(left: DataFrame, right: DataFrame, within_us: int, key: str = "camera_id") -> DataFrame:
    """Pairs of a camera less than within_us apart: rows meet in bins of that width, the right side in its neighbours too."""
    a = left.withColumn("__bin", F.floor(F.col("ts_us") / within_us))
    b = right.select(F.col(key).alias("__k"), F.col("ts_us").alias("near_us"), F.col("seq").alias("near_seq"))
    b = b.withColumn("__b", F.explode(F.array(*[F.floor(F.col("near_us") / within_us) + k for k in (-1, 0, 1)])))
    met = a.join(b, (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__b")) & (F.abs(F.col("ts_us") - F.col("near_us")) < within_us))
    return met.drop("__bin", "__b", "__k")


def single_site(cameras: DataFrame) -> DataFrame:
    """The site of a deployment with one site, else null."""
    return cameras.agg(F.when(F.count_distinct("site_id") == 1, F.max("site_id")).alias("site_id"))

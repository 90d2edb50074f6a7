"""Reading and writing: explicit schemas, Parquet tables by day, JSON lines with quarantine, CSV, and JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_ROW = "zone_id string, camera_id string, zone_name string, zone_type string, restricted boolean, ts double, occupancy long, density double, capacity_pct double, peak_occupancy long, avg_occupancy double, trend string, extra string, inflow double, outflow double, status string, site_id string"
EVENT_ROW = "event_id string, event_type string, camera_id string, site_id string, zone_id string, zone_from string, zone_to string, person_ref string, ts double, frame string, payload string"
ALERT_ROW = "alert_id string, rule_id string, severity string, message string, zone_id string, camera_id string, person_ref string, ts double, frame string, kind string, acknowledged_by string, acknowledged_at double, status string, note string, resolved_by string, resolved_at double, site_id string"
CAMERA_ROW = "camera_id string, site_id string, last_seen double, name string, state string, input_fps double, resolution string, dropped_frames long, reconnects long, loops long, frozen boolean, enabled boolean, stream_url string, health_ts double, source string, people_in_view long, people_in_zones long"
SCHEMAS = {"zone_state": STATE_ROW, "events": EVENT_ROW, "alerts": ALERT_ROW, "cameras": CAMERA_ROW}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table by its own schema: absent columns are null, which is how additive changes are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_by_day(rows: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Partitioned by day, so that ranges of time and retention touch only their days; seconds or microseconds by type."""
    seconds = F.col(ts) if isinstance(rows.schema[ts].dataType, T.DoubleType) else F.col(ts) / 1e6
    day = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")
    rows.withColumn("dt", day).repartition("dt", F.pmod(F.xxhash64("camera_id"), F.lit(16))).write.mode(mode).partitionBy("dt").parquet(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One payload a line as text; checks come before any typing."""
    return spark.read.text(path).select(F.col("value").alias("payload"))


def write_json_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Evidence files: one JSON object a line, nulls included, in a folder for each value of ``by``."""
    writer = rows.write.mode("append").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A table of a database, read in ranges of a numeric column; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions).load()


def copy(source: DataFrame, path: str, known: int = 0, target: DataFrame | None = None) -> int:
    """Bulk copy; refuses if the target holds more rows than the source. A target that is there keeps its columns: those that the source has
    as well are copied, in the target's order and types, and the others are null."""
    n = source.count()
    known = target.count() if target is not None else known
    if known > n:
        raise ValueError(f"the target has {known} rows, the source {n}")
    if target is not None:
        common = [f.name for f in target.schema if f.name in source.columns]
        if not common:
            raise ValueError("source and target have no column in common")
        source = source.select(*[(F.col(f.name) if f.name in common else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])
    source.write.mode("overwrite").parquet(path)
    return n


def backend(spark: SparkSession, settings: Mapping[str, str]) -> Callable[[str], DataFrame]:
    """Where tables are read, by settings such as os.environ: of a database where ZONELAKE_DATABASE_URL is set (by JDBC; read_jdbc()
    reads a large table in ranges), of temporary views where ZONELAKE_INMEMORY is, else as Parquet under ZONELAKE_WAREHOUSE or data."""
    if url := settings.get("ZONELAKE_DATABASE_URL"):
        return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize="10000").load()
    if settings.get("ZONELAKE_INMEMORY"):
        return spark.table
    folder = settings.get("ZONELAKE_WAREHOUSE") or "data"
    return lambda name: read(spark, f"{folder}/{name}", name)


def redact_cameras(cameras: DataFrame, keep_source: bool = False) -> DataFrame:
    """Cameras as they may be shown: credentials in urls masked, and the source left out."""
    from zonelake.functions.identity import mask_credentials

    out = cameras.select(*[mask_credentials(F.col(c)).alias(c) if c in ("stream_url", "rtsp_url", "source") else F.col(c) for c in cameras.columns])
    return out if keep_source else out.drop("source")

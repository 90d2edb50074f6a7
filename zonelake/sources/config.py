"""Zones, cameras and topology from configuration (mappings as parsed from JSON or YAML) to small DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ZONE = "camera_id string, zone_id string, zone_name string, zone_type string, restricted boolean, capacity_max long, area_sqm double, warning_density double, critical_density double, ord int, polygon array<struct<x:double,y:double>>"
TOPOLOGY = "a string, b string, kind string, min_us long, max_us long"


def parsed(path: str) -> dict:
    """A small file on the driver: JSON, or YAML where its package is installed."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def zones(spark: SparkSession, cameras: list[dict]) -> DataFrame:
    """Zones in the order of the configuration. Type and flag agree, whichever is given; normalised corners become pixels."""
    rows = []
    for camera in cameras:
        w, h = camera.get("width", 1.0), camera.get("height", 1.0)
        for k, z in enumerate(camera.get("zones", [])):
            kind = str(z.get("zone_type") or ("RESTRICTED" if z.get("restricted") else "MONITORED")).upper()
            corners = [(float(x) * w, float(y) * h) for x, y in z["normalized_polygon"]] if z.get("normalized_polygon") else [(float(x), float(y)) for x, y in z.get("polygon", [])]
            number = lambda n, default=0.0, z=z: float(z.get(n) if z.get(n) is not None else default)
            rows.append((camera["camera_id"], z["zone_id"], z.get("zone_name", z["zone_id"]), kind, kind == "RESTRICTED", int(number("capacity_max")), number("area_sqm"), number("warning_density", 2.0), number("critical_density", 4.0), k, corners))
    return spark.createDataFrame(rows, ZONE)


def topology(spark: SparkSession, overlaps: list[tuple[str, str]], transits: list[tuple[str, str, float, float]]) -> DataFrame:
    """Undirected pairs with their windows in microseconds; a window that ends before it begins is an error."""
    rows = [(min(a, b), max(a, b), "OVERLAP", 0, 120_000_000) for a, b in overlaps]
    for a, b, lo, hi in transits:
        if lo < 0 or hi < lo:
            raise ValueError(f"no such window for {a} and {b}: {lo} to {hi}")
        rows.append((min(a, b), max(a, b), "TRANSIT", int(lo * 1e6), int(hi * 1e6)))
    return spark.createDataFrame(rows, TOPOLOGY)

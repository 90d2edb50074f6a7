"""Scalar expressions over readings and boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def density(occupancy: Column, area: Column) -> Column:
    """People per square metre; 0 where no area is known."""
    return F.when(area > 0, occupancy / area).otherwise(F.lit(0.0))


def capacity_pct(occupancy: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, F.lit(100.0) * occupancy / capacity).otherwise(F.lit(0.0))


def density_status(value: Column, warning: Column, critical: Column) -> Column:
    """Strictly over a threshold; the latch of alerts uses at or over."""
    return F.when(value > critical, "CRITICAL").when(value > warning, "WARNING").otherwise("NORMAL")


def align_down(ts_us: Column, step_us: int) -> Column:
    return ts_us - F.pmod(ts_us, F.lit(step_us))


def foot_x(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def foot_y(y1: Column, y2: Column) -> Column:
    return F.greatest(y1, y2)


def iou(a: tuple, b: tuple, area_b: Column | None = None) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2). The second one's area may be given, as corners of a box that was moved
    give it with another last digit."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + ((b[2] - b[0]) * (b[3] - b[1]) if area_b is None else area_b) - w * h
    return F.when(union > 0, w * h / union).otherwise(zero)


def crop_reject(x1: Column, y1: Column, x2: Column, y2: Column, confidence: Column, width: int, height: int) -> Column:
    """Why a crop is no good for a signature, the first reason that holds; null if it is good."""
    w, h = x2 - x1, y2 - y1
    edge_x, edge_y = max(6.0, 0.01 * width), max(6.0, 0.01 * height)
    return (
        F.when(confidence < 0.5, "low_confidence")
        .when((w < 32) | (h < 96), "too_small")
        .when((w / h < 0.15) | (w / h > 1.1), "bad_aspect")
        .when((x1 < edge_x) | (y1 < edge_y) | (x2 > width - edge_x) | (y2 > height - edge_y), "at_edge")
    )


def zone_label(camera: Column, name: Column, n_cameras: Column) -> Column:
    return F.when(n_cameras > 1, F.concat(camera, F.lit(" / "), name)).otherwise(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(name: Column) -> Column:
    """A name for a path or an id: lower case, one hyphen for whatever isn't a letter or digit, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def camera_state(enabled: Column, health_us: Column, state: Column, now_us: Column, limit_us: int = 30_000_000) -> Column:
    """What to show for a camera: disabled, offline after silence, else what it last said."""
    silent = health_us.isNull() | (now_us - health_us > limit_us)
    return F.when(~enabled, "DISABLED").when(silent, "OFFLINE").otherwise(F.upper(state))


def comparison(field: str, op: str, value: float) -> Column:
    """A condition from closed sets of fields and operators; anything else is an error, null compares as false."""
    if field not in ("occupancy", "density", "capacity_pct"):
        raise ValueError(f"no such field: {field}")
    c = F.col(field)
    tests = {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value, "eq": c == value}
    if op not in tests:
        raise ValueError(f"no such operator: {op}")
    return F.coalesce(tests[op], F.lit(False))


def has_status(status: str) -> Column:
    return F.upper(F.coalesce(F.col("status"), F.lit(""))) == status.upper()

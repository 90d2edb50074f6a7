"""Questions by name with loose arguments, as an assistant or a form sends them, answered as DataFrames.

Arguments that are null aren't there; unknown ones, unknown tools and zones that several cameras have are errors, never an
empty answer. Times are microseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelake.functions import scalars
from zonelake.operators import asof, intervals, series, store
from zonelake.operators.series import KEY
from zonelake.plans import reports

HOUR = 3_600_000_000
WINDOW = {"hours", "from", "to"}
#: What a tool takes, and how many hours it looks back if it isn't told.
TOOLS = {
    "live_state": ({"camera_id"}, None),
    "zone_history": ({"zone_id", "camera_id", "bucket", *WINDOW}, 6),
    "zone_at_time": ({"zone_id", "camera_id", "ts"}, None),
    "zone_duration": ({"zone_id", "camera_id", "field", "op", "value", "status", *WINDOW}, 24),
    "alerts": ({"camera_id", "zone_id", "rule_id", "severity", "status", "limit", *WINDOW}, 24),
    "occupancy_report": ({"camera_id", "zone_id", *WINDOW}, 24),
}
BUCKET_US, LIMIT = 300_000_000, 100


@dataclass
class Site:
    """The tables that tools read."""

    states: DataFrame
    camera_events: DataFrame
    alerts: DataFrame
    zones: DataFrame
    max_hold_us: int

    def outages(self, t0: int, t1: int) -> DataFrame:
        return intervals.offline(self.camera_events, t0, t1)


def window(args: dict, hours: float, now_us: int) -> tuple[int, int]:
    """From and to as given; what isn't is now, and so many hours before."""
    t1 = int(args.get("to", now_us))
    return int(args.get("from", t1 - int(args.get("hours", hours) * HOUR))), t1


def checked(name: str, args: dict | None) -> dict:
    if name not in TOOLS:
        raise ValueError(f"no such tool: {name}")
    given = {k: v for k, v in (args or {}).items() if v is not None}
    if unknown := sorted(set(given) - TOOLS[name][0]):
        raise ValueError(f"{name} doesn't take {', '.join(unknown)}")
    return given


def one_zone(site: Site, args: dict) -> DataFrame:
    """The readings of the zone that is meant, which only a camera's name can make clear where several have it."""
    if "zone_id" not in args:
        raise ValueError("zone_id is missing")
    camera, zone = store.resolve_zone(site.zones, site.states, args["zone_id"], args.get("camera_id"))
    return site.states.where((F.col("camera_id") == camera) & (F.col("zone_id") == zone))


def equal(rows: DataFrame, args: dict, *names: str) -> DataFrame:
    for n in names:
        rows = rows.where(F.col(n) == args[n]) if n in args else rows
    return rows


def run(site: Site, name: str, args: dict | None, now_us: int) -> DataFrame:
    args = checked(name, args)
    if name == "live_state":
        return store.fresh(store.live_rows(equal(site.states, args, "camera_id")), now_us)
    if name == "zone_at_time":
        at = int(args.get("ts", now_us))
        rows = one_zone(site, args)
        asked = rows.select(*KEY).distinct().withColumn("at_us", F.lit(at))
        return asof.zone_at(asked, rows, site.outages(0, at), site.max_hold_us)
    t0, t1 = window(args, TOOLS[name][1], now_us)
    if name == "alerts":
        rows = store.in_range(site.alerts, t0, t1)
        rows = store.matching(rows, **{k: args[k] for k in ("camera_id", "zone_id", "rule_id", "severity", "status") if k in args})
        return store.newest(rows, int(args.get("limit", LIMIT)))
    if name == "zone_history":
        step = series.bucket_step(t0, t1, int(args.get("bucket", BUCKET_US)))
        return series.bucket_series(one_zone(site, args), site.outages(t0, t1), t0, t1, step, "occupancy", site.max_hold_us)
    if name == "zone_duration":
        # A status and a comparison are alternatives; with both, the status is meant.
        condition = scalars.has_status(args["status"]) if "status" in args else scalars.comparison(args.get("field"), args.get("op"), args.get("value"))
        return series.duration_where(one_zone(site, args), site.outages(t0, t1), t0, t1, condition, site.max_hold_us)
    rows = equal(site.states, args, "camera_id", "zone_id")
    weighted = series.time_weighted(rows, site.outages(t0, t1), t0, t1, ["occupancy", "density"], site.max_hold_us)
    return reports.occupancy_report(weighted, store.stats(rows, t0, t1), store.in_range(site.alerts, t0, t1), site.zones)

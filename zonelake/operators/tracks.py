"""Tracks and flows: sessions, dwell, movement events, rolling rates, loitering, intrusion and silence of cameras."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelake.operators import folds
from zonelake.operators import intervals as iv
from zonelake.operators import order_stats
from zonelake.operators.series import KEY, place_of

SECOND = 1_000_000
FLOW_WINDOWS = {"1m": 60 * SECOND, "5m": 300 * SECOND, "15m": 900 * SECOND}


def rolling(rows: DataFrame, keys: list[str], span_us: int, columns: Callable[[Window], dict[str, Column]], chunk_us: int = 86_400 * SECOND) -> DataFrame:
    """Adds aggregates over the rows of the last span_us, both ends included.

    A key's time is cut into chunks, each with the rows before it that its frames reach as context, so a key with very
    many rows is spread over its chunks. columns gets the window and gives the aggregates by name.
    """
    chunk_us = max(chunk_us, span_us)
    own = rows.withColumn("__chunk", F.floor(F.col("ts_us") / chunk_us)).withColumn("__context", F.lit(False))
    reached = own.where((F.col("__chunk") + 1) * chunk_us - F.col("ts_us") <= span_us).withColumn("__chunk", F.col("__chunk") + 1).withColumn("__context", F.lit(True))
    w = Window.partitionBy(*keys, "__chunk").orderBy("ts_us").rangeBetween(-span_us, 0)
    return own.union(reached).withColumns(columns(w)).where("not __context").drop("__chunk", "__context")


def flow_rates(crossings: DataFrame) -> DataFrame:
    """At each crossing (zone_id, kind in or out): people per minute in and out over 1, 5 and 15 minutes, and the net."""

    def columns(_) -> dict[str, Column]:
        """All frames in the chunks of the longest one, so the rows are dealt and sorted once."""
        frame = lambda span: Window.partitionBy(*KEY, "__chunk").orderBy("ts_us").rangeBetween(-span, 0)
        count = lambda kind, span: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(frame(span))
        return {f"{flow}_{name}": F.round(count(kind, span) * F.lit(60.0 * SECOND / span), 2) for name, span in FLOW_WINDOWS.items() for kind, flow in (("in", "inflow"), ("out", "outflow"))}

    out = rolling(crossings, KEY, max(FLOW_WINDOWS.values()), columns)
    return out.withColumn("net_flow", F.round(F.col("inflow_1m") - F.col("outflow_1m"), 2))


def crossings(movements: DataFrame) -> DataFrame:
    """Pure entries and exits; a transition is neither inflow nor outflow."""
    pure = movements.where(F.col("event_type").isin("ZONE_ENTRY", "ZONE_EXIT"))
    return pure.select("seq", "ts_us", "camera_id", F.coalesce("zone_to", "zone_from").alias("zone_id"), F.when(F.col("event_type") == "ZONE_ENTRY", "in").otherwise("out").alias("kind"))


def rolling_stats(states: DataFrame, span_us: int = 300 * SECOND) -> DataFrame:
    """Adds the mean over the span, and the trend: its newer half against its older half, 15 % either way, 4 rows at least."""
    half = span_us // 2

    def columns(w) -> dict[str, Column]:
        newer = Window.partitionBy(*KEY, "__chunk").orderBy("ts_us").rangeBetween(-half, 0)
        older = Window.partitionBy(*KEY, "__chunk").orderBy("ts_us").rangeBetween(-span_us, -half - 1)
        return {"avg_occupancy": F.avg("occupancy").over(w), "__n": F.count("*").over(w), "__new": F.avg("occupancy").over(newer), "__old": F.avg("occupancy").over(older)}

    out = rolling(states, KEY, span_us, columns)
    trend = F.when((F.col("__n") < 4) | F.col("__old").isNull(), "flat").when(F.col("__new") > F.col("__old") * 1.15, "rising").when(F.col("__new") < F.col("__old") * 0.85, "falling").otherwise("flat")
    return out.withColumn("trend", trend).drop("__n", "__new", "__old")


def running_peak(states: DataFrame) -> DataFrame:
    """Adds the highest occupancy of the key so far: within a day by a window, before it by the maxima of earlier days."""
    chunked = states.withColumn("__day", F.floor(F.col("ts_us") / (86_400 * SECOND)))
    inside = F.max("occupancy").over(Window.partitionBy(*KEY, "__day").orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0))
    days = chunked.groupBy(*KEY, "__day").agg(F.max("occupancy").alias("__max"))
    days = days.withColumn("__before", F.max("__max").over(Window.partitionBy(*KEY).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).drop("__max")
    return chunked.withColumn("__in", inside).join(days, [*KEY, "__day"]).withColumn("peak_so_far", F.greatest("__in", "__before")).drop("__day", "__in", "__before")


def last_in_window(states: DataFrame, period: str = "5 seconds") -> DataFrame:
    """One reading per key and period of the clock: the last in it."""
    rows = states.withColumn("window", F.window(F.timestamp_micros("ts_us"), period))
    return rows.groupBy(*KEY, F.unix_micros("window.start").alias("window_us")).agg(F.max_by("occupancy", place_of(["ts_us", "seq"])).alias("occupancy"), F.max("ts_us").alias("ts_us"), F.count("*").alias("samples"))


def islands(rows: DataFrame, keys: list[str], starts: Column, into: str = "island") -> DataFrame:
    """Numbers the stretches of a key's rows; ``starts`` says where one begins."""
    w = Window.partitionBy(*keys).orderBy("ts_us", "seq")
    return rows.withColumn(into, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def numbered(observations: DataFrame, key: list[str], ttl_us: int) -> DataFrame:
    """Adds the session of a row: a silence of more than the TTL ends one."""
    before = F.lag("ts_us").over(Window.partitionBy(*key).orderBy("ts_us", "seq"))
    marked = observations.withColumn("__new", before.isNull() | (F.col("ts_us") - before > ttl_us))
    return islands(marked, key, F.col("__new"), "session").drop("__new")


def sessions(observations: DataFrame, key: list[str], ttl_us: int = 5 * SECOND) -> DataFrame:
    """Lifecycle of tracks: a silence of more than the TTL ends one. Zones in order, without neighbours of the same name."""
    listed = numbered(observations, key, ttl_us).groupBy(*key, "session").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts_us", "seq", "zone_id"))).alias("__seen"))
    visited = F.filter("__seen", lambda x, i: x["zone_id"].isNotNull() & ((i == 0) | ~x["zone_id"].eqNullSafe(F.get(F.col("__seen"), i - 1)["zone_id"])))
    return listed.withColumn("zones_visited", F.transform(visited, lambda x: x["zone_id"])).drop("__seen")


END = "camera_id string, track_id long, first_us long, last_us long, n long, zone_id string, exit_us long"


def ends(observations: DataFrame, key: list[str], ttl_us: int = 5 * SECOND, until_us: int | None = None) -> DataFrame:
    """Sessions that have ended by until_us: their place in time, and the exit (zone_id, exit_us) of a track that vanished inside a zone,
    without which occupancy counted from events would never come down. A track is gone ttl_us after it was last seen."""
    sized = numbered(observations, key, ttl_us).groupBy(*key, "session").agg(F.min("ts_us").alias("first_us"), F.max(place_of(["ts_us", "seq"])).alias("__place"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"))
    last = observations.select(*key, F.col("zone_id"), place_of(["ts_us", "seq"]).alias("__place"))
    found = sized.join(last, [*key, "__place"])
    gone = F.lit(True) if until_us is None else F.col("last_us") + ttl_us < until_us
    return found.where(gone).select(*key, "first_us", "last_us", "n", "zone_id", F.when(F.col("zone_id").isNotNull(), F.col("last_us") + ttl_us).alias("exit_us"))


def track_states(observations: DataFrame, key: list[str], now_us: int, ttl_us: int = 5 * SECOND) -> DataFrame:
    """(key, first_us, last_us, n, state) of each session begun by now_us: tentative until it was in a zone, tracked from then on,
    completed once it has been gone for more than the TTL."""
    begun = numbered(observations.where(F.col("ts_us") <= now_us), key, ttl_us)
    sized = begun.groupBy(*key, "session").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n"), F.count("zone_id").alias("__in"))
    state = F.when(now_us - F.col("last_us") > ttl_us, "completed").when(F.col("__in") > 0, "tracked").otherwise("tentative")
    return sized.withColumn("state", state).drop("session", "__in")


@dataclass
class Presence:
    """One track, for rows in order of time."""

    ttl_us: int
    first_us: int = 0
    last_us: int | None = None
    n: int = 0
    zone: str | None = None

    def step(self, row: dict) -> list[tuple]:
        if self.last_us is None:
            self.first_us, self.n = row["ts_us"], 0
        self.last_us, self.zone, self.n = row["ts_us"], row["zone_id"], self.n + 1
        return []

    def deadline(self) -> int | None:
        return None if self.last_us is None else self.last_us + self.ttl_us

    def expire(self, now: int) -> list[tuple]:
        out = [(self.first_us, self.last_us, self.n, self.zone, None if self.zone is None else now)]
        self.last_us = None
        return out


def dwell(observations: DataFrame, key: list[str]) -> DataFrame:
    """Adds how long a track has been in its zone without leaving it, and the number of that stay; 0 outside of zones."""
    w = Window.partitionBy(*key).orderBy("ts_us", "seq")
    before = F.lag(F.struct("zone_id")).over(w)
    marked = observations.withColumn("__new", before.isNull() | ~before["zone_id"].eqNullSafe(F.col("zone_id")))
    stays = islands(marked, key, F.col("__new"), "stay").drop("__new")
    since = F.min("ts_us").over(Window.partitionBy(*key, "stay"))
    return stays.withColumn("dwell_us", F.when(F.col("zone_id").isNull(), F.lit(0)).otherwise(F.col("ts_us") - since))


def loitering(stays: DataFrame, key: list[str], threshold_us: int = 30 * SECOND) -> DataFrame:
    """One alert per stay: the first row at which dwell reaches the threshold."""
    late = stays.where(F.col("zone_id").isNotNull() & (F.col("dwell_us") >= threshold_us))
    return late.groupBy(*key, "stay", "zone_id").agg(F.min("ts_us").alias("ts_us"), F.lit("R-05").alias("rule_id"))


def intrusions(stays: DataFrame, key: list[str], zones: DataFrame) -> DataFrame:
    """One alert per stay in a restricted zone, at its first row."""
    restricted = F.broadcast(zones.where("restricted").select(*KEY))
    return stays.join(restricted, KEY, "left_semi").groupBy(*dict.fromkeys([*key, "camera_id", "zone_id", "stay"])).agg(F.min("ts_us").alias("ts_us"), F.lit("R-06").alias("rule_id"))


def silences(heartbeats: DataFrame, limit_us: int = 30 * SECOND, poll_us: int = 5 * SECOND, until_us: int | None = None) -> DataFrame:
    """Rule R-07: FIRE at the first poll after more than limit_us of silence, CLEAR when the camera is heard again. A silence that is
    still open fires if its poll is not after until_us."""
    gaps = iv.hold_forward(heartbeats.select("camera_id", "ts_us").distinct(), ["camera_id"], seq="ts_us")
    polled = (F.floor((F.col("ts_us") + limit_us) / poll_us) + 1) * poll_us
    ended = F.lit(False) if until_us is None else F.col("next_us").isNull() & (F.col("fire_us") <= until_us)
    fired = gaps.withColumn("fire_us", polled).where((F.col("fire_us") < F.col("next_us")) | ended)
    pair = F.array(F.struct(F.lit("FIRE").alias("kind"), F.col("fire_us").alias("ts_us")), F.struct(F.lit("CLEAR").alias("kind"), F.col("next_us").alias("ts_us")))
    return fired.select("camera_id", F.explode(pair).alias("a")).where("a.ts_us IS NOT NULL").select("camera_id", F.lit("R-07").alias("rule_id"), "a.kind", "a.ts_us")


@dataclass
class Silence:
    """Rule R-07 for one camera, for rows in order of time."""

    limit_us: int
    poll_us: int
    last_us: int | None = None
    fired: bool = False

    def step(self, row: dict) -> list[tuple]:
        out = [("R-07", "CLEAR", row["ts_us"])] if self.fired else []
        self.last_us, self.fired = row["ts_us"], False
        return out

    def deadline(self) -> int | None:
        return None if self.last_us is None or self.fired else ((self.last_us + self.limit_us) // self.poll_us + 1) * self.poll_us

    def expire(self, now: int) -> list[tuple]:
        self.fired = True
        return [("R-07", "FIRE", now)]


def movement_events(changes: DataFrame) -> DataFrame:
    """Events of confirmed zone changes (zone_from, zone_to): entry, exit or transition."""
    kind = F.when(F.col("zone_from").isNull(), "ZONE_ENTRY").when(F.col("zone_to").isNull(), "ZONE_EXIT").otherwise("ZONE_TRANSITION")
    return changes.withColumn("event_type", kind)


def stamp_occupancy(movements: DataFrame, observations: DataFrame) -> DataFrame:
    """Adds how many tracks a frame had in the zone entered and in the zone left."""
    counts = observations.where("zone_id is not null").groupBy("camera_id", "ts_us", "zone_id").agg(F.count_distinct("track_id").alias("n"))
    named = lambda zone, n: counts.select("camera_id", "ts_us", F.col("zone_id").alias(zone), F.col("n").alias(n))
    out = movements.join(named("zone_to", "occupancy"), ["camera_id", "ts_us", "zone_to"], "left").join(named("zone_from", "occupancy_from"), ["camera_id", "ts_us", "zone_from"], "left")
    return out.fillna(0, ["occupancy", "occupancy_from"])


def presence(rows: DataFrame, keys: list[str], value: str, q: float = 0.75) -> DataFrame:
    """(keys, presence): of each group's values the one at floor(n * q), counted from 0, at most the last."""
    return order_stats.select(rows, keys, value, {"presence": order_stats.upper_quantile(q)}).drop("n")


def bank(observations: DataFrame, key: list[str], vector: str, k: int = 5) -> DataFrame:
    """The last k vectors of each key in order, found by rank, so that no array of all of them is built."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts_us"), F.desc("seq")))
    last = observations.withColumn("__place", place).where(F.col("__place") <= k)
    return last.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("__place"), F.col(vector).alias("v")))), lambda x: x["v"]).alias("bank"))


def frame_budget(candidates: DataFrame, budget: int = 8) -> DataFrame:
    """Of each frame the tracks with the fewest samples, at most ``budget``."""
    place = F.row_number().over(Window.partitionBy("camera_id", "ts_us").orderBy("samples", "track_id"))
    return candidates.withColumn("__place", place).where(F.col("__place") <= budget).drop("__place")


def cluster_stats(detections: DataFrame, key: list[str], threshold: float = 0.4, moving: float = 20.0) -> DataFrame:
    """Confidence of each group of detections, the share at or over a threshold, and whether its foot point moved."""
    x, y = (F.col("x1") + F.col("x2")) / 2, F.greatest("y1", "y2")
    out = detections.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("confidence").alias("min_confidence"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.max("confidence").alias("max_confidence"),
        F.round(100.0 * F.count_if(F.col("confidence") >= threshold) / F.count("*"), 4).alias("pct_over"), F.round(F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)), 6).alias("displacement"),
    )
    return out.withColumn("kind", F.when(F.col("displacement") >= moving, "MOVING").otherwise("STATIC"))


def boxes_per_frame(detections: DataFrame) -> DataFrame:
    """Per camera: frames with boxes, and the mean, least and most boxes of one."""
    frames = detections.groupBy("camera_id", "ts_us").agg(F.count("*").alias("n"))
    return frames.groupBy("camera_id").agg(F.count("*").alias("frames"), F.round(F.avg("n"), 6).alias("mean_boxes"), F.min("n").alias("min_boxes"), F.max("n").alias("max_boxes"))


def ground_truth(tracks_: DataFrame, truth: DataFrame, at_least: float = 0.5, hits: int = 3) -> DataFrame:
    """For each track the true person whose box it overlaps best, frame by frame, if that holds in enough frames.

    Boxes meet in cells of their frame (geometry.meeting()), as a box of another cell can't overlap. Of people whose boxes overlap
    equally well the first counts, so last digits matter: where a truth's box was moved, a column ``area`` has its area from before.
    """
    from zonelake.functions.scalars import iou
    from zonelake.operators.geometry import meeting

    corners = ("x1", "y1", "x2", "y2")
    sized = ["area"] if "area" in truth.columns else []
    pairs = meeting(tracks_.select("camera_id", "ts_us", "track_id", *corners), truth.select("camera_id", "ts_us", "person", *corners, *sized), ["camera_id", "ts_us"])
    overlap = iou(tuple(map(F.col, corners)), tuple(F.col(f"r_{c}") for c in corners), F.col("r_area") if sized else None)
    both = pairs.withColumn("iou", overlap).withColumnRenamed("r_person", "person")
    best = both.where(F.col("iou") >= at_least).groupBy("camera_id", "ts_us", "track_id").agg(F.max_by("person", F.struct("iou", (-F.col("person")).alias("p"))).alias("person"))
    counted = best.groupBy("camera_id", "track_id", "person").agg(F.count("*").alias("hits")).where(F.col("hits") >= hits)
    return counted.groupBy("camera_id", "track_id").agg(F.max_by("person", F.struct("hits", (-F.col("person")).alias("p"))).alias("person"), F.max("hits").alias("hits"))


def sampled(candidates: DataFrame, interval_us: int = SECOND, most: int = 5, budget: int = 8) -> DataFrame:
    """Which crops of a camera are embedded: a track at most once in the interval and ``most`` times, a frame at most
    ``budget``, tracks with fewer samples first. Frames of a camera in order, as each choice depends on those before."""
    from zonelake.operators.folds import ordered

    frames = candidates.groupBy("camera_id", "ts_us").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_set("track_id")).alias("tracks"))

    def step(taken: dict, row: dict) -> list[tuple]:
        due = [t for t in row["tracks"] if taken.get(t, (0, None))[0] < most and (t not in taken or row["ts_us"] - taken[t][1] >= interval_us)]
        chosen = sorted(due, key=lambda t: (taken.get(t, (0, 0))[0], t))[:budget]
        for t in chosen:
            taken[t] = (taken.get(t, (0, 0))[0] + 1, row["ts_us"])
        return [(row["camera_id"], row["ts_us"], int(t), taken[t][0]) for t in chosen]

    return ordered(frames, ["camera_id"], dict, step, "camera_id string, ts_us long, track_id long, sample long")


class Clusters:
    """Places of a source where boxes were seen: each frame's boxes take, in order, the nearest place within reach that no
    other box of the frame has taken, or make a new one. A place is the mean of its boxes' centres.

    Free places lie in the cells of a grid, and a search leaves out cells that are farther away than what it has found. So the work
    for a box follows from the free places around it and not from all that were made or taken.
    """

    #: Cells along the reach.
    FINE = 3

    def __init__(self, reach: float) -> None:
        self.reach, self.cell, self.frame = reach, reach / self.FINE or 1.0, None
        self.at, self.sums, self.taken = [], [], []  # at: places as complex numbers, whose abs() is hypot()
        self.free: dict[int, dict[int, dict[int, complex]]] = {}  # by column and row of the grid
        self.steps = sorted(range(-self.FINE - 1, self.FINE + 2), key=abs)
        self.slack = 1e-9 * self.cell  # cells are found by rounded division

    def cell_of(self, at: complex) -> tuple[int, int]:
        return math.floor(at.real / self.cell), math.floor(at.imag / self.cell)

    def nearest(self, at: complex) -> int | None:
        """Of the free places within reach the nearest, of several the one made first."""
        best, near, cell, (cx, cy) = self.reach, None, self.cell, self.cell_of(at)
        fx, fy = at.real - cx * cell, at.imag - cy * cell
        # How far the cells of a column or row are away at least.
        off = lambda f, d: d * cell - f if d > 0 else f - (d + 1) * cell if d < 0 else 0.0
        rows = None
        for dx in self.steps:
            column = self.free.get(cx + dx)
            if not column or (ax := off(fx, dx)) > best + self.slack:
                continue
            rows = rows or [(cy + dy, off(fy, dy)) for dy in self.steps]
            for row, ay in rows:
                here = column.get(row)
                if not here or ax * ax + ay * ay > (best + self.slack) ** 2:
                    continue
                for k, place in here.items():
                    apart = abs(at - place)
                    if apart <= best and (apart < best or near is None or k < near):
                        best, near = apart, k
        return near

    def add(self, frame: int, x: float, y: float) -> int:
        if frame != self.frame:
            for k in self.taken:
                cx, cy = self.cell_of(self.at[k])
                self.free.setdefault(cx, {}).setdefault(cy, {})[k] = self.at[k]
            self.frame, self.taken = frame, []
        at = complex(x, y)
        k = self.nearest(at)
        if k is None:
            k = len(self.at)
            self.sums.append((0.0, 0.0, 0))
            self.at.append(at)
        else:
            cx, cy = self.cell_of(self.at[k])
            here = self.free[cx][cy]
            del here[k]
            if not here:
                del self.free[cx][cy]
        sx, sy, n = self.sums[k]
        self.sums[k] = sx, sy, n = sx + x, sy + y, n + 1
        self.at[k] = complex(sx / n, sy / n)
        self.taken.append(k)
        return k


def position_clusters(boxes: DataFrame, reach: float, source: str = "camera_id") -> DataFrame:
    """(source, ts_us, seq, cluster) of boxes (source, ts_us, seq, x1, y1, x2, y2); ts_us is the frame. In order within a
    source, as each frame's places depend on those before it; it needs no more than the places it has made."""
    schema = f"{source} {dict(boxes.dtypes)[source]}, ts_us long, seq long, cluster int"

    def step(state: Clusters, row: dict) -> list[tuple]:
        return [(row[source], row["ts_us"], row["seq"], state.add(row["ts_us"], row["x"], row["y"]))]

    centred = boxes.select(source, "ts_us", "seq", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return folds.ordered(centred, [source], lambda: Clusters(reach), step, schema)

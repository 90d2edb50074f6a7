"""Points, polygons and zones. Polygons are arrays of (x, y); zones of a camera are few, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE = 1e-9


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon; its edges belong to it, and fewer than three corners hold nothing."""
    following = F.concat(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    edges = F.zip_with(polygon, following, lambda p, q: F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))

    def on_edge(e: Column) -> Column:
        cross = (e["qx"] - e["px"]) * (y - e["py"]) - (e["qy"] - e["py"]) * (x - e["px"])
        within = lambda v, a, b: (v >= F.least(a, b) - EDGE) & (v <= F.greatest(a, b) + EDGE)
        return (F.abs(cross) <= EDGE) & within(x, e["px"], e["qx"]) & within(y, e["py"], e["qy"])

    def crosses(e: Column) -> Column:
        rise = F.when(e["qy"] != e["py"], e["qy"] - e["py"]).otherwise(F.lit(1.0))
        return ((e["py"] > y) != (e["qy"] > y)) & (x < e["px"] + (y - e["py"]) * (e["qx"] - e["px"]) / rise)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(F.size(polygon) < 3, F.lit(False)).otherwise(F.exists(edges, on_edge) | odd)


def drop_masked(points: DataFrame, masks: DataFrame) -> DataFrame:
    """Points that lie in no mask of their camera."""
    m = F.broadcast(masks.select(F.col("camera_id").alias("__camera"), F.col("polygon").alias("__mask")))
    return points.join(m, (F.col("camera_id") == F.col("__camera")) & contains(F.col("__mask"), F.col("x"), F.col("y")), "left_anti")


def assign_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds zone_id: of the camera's zones that hold the point, a restricted one first, then the first in order.

    The zones of a camera travel as one array in a broadcast row, so each point stays one row and nothing is shuffled.
    """
    listed = zones.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("restricted")).alias("rank"), "ord", "zone_id", "polygon"))).alias("__zones"))
    joined = points.join(F.broadcast(listed), "camera_id", "left")
    hit = F.filter("__zones", lambda z: contains(z["polygon"], F.col("x"), F.col("y")))
    return joined.withColumn("zone_id", F.get(hit, F.lit(0))["zone_id"]).drop("__zones")


def scaled(polygon: Column, width: float, height: float) -> Column:
    """Normalised corners in pixels."""
    return F.transform(polygon, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def meeting(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 160.0) -> DataFrame:
    """Pairs of boxes of a key that overlap, once each; right's columns but for the keys get the prefix r_.

    Boxes meet in the cells of a grid that both lie in, and the cell that holds the upper left corner of what they share is the
    pair's owner, so a crowded frame is spread over its cells and boxes far apart never meet.
    """
    spread = lambda df, x1, y1, x2, y2: df.withColumn("__cx", F.explode(_cells(x1, x2, cell))).withColumn("__cy", F.explode(_cells(y1, y2, cell)))
    mine = spread(left, "x1", "y1", "x2", "y2")
    others = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    both = mine.join(spread(others, "r_x1", "r_y1", "r_x2", "r_y2"), [*keys, "__cx", "__cy"])
    x, y = F.greatest("x1", "r_x1"), F.greatest("y1", "r_y1")
    shares = (x < F.least("x2", "r_x2")) & (y < F.least("y2", "r_y2"))
    owner = (F.col("__cx") == F.floor(x / cell)) & (F.col("__cy") == F.floor(y / cell))
    return both.where(shares & owner).drop("__cx", "__cy")


def _cells(a: str, b: str, cell: float) -> Column:
    """The cells from a to b; none for a box without extent."""
    return F.when(F.col(b) > F.col(a), F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))


def occluded(boxes: DataFrame, share: float = 0.25) -> DataFrame:
    """Adds whether another box of the frame (camera_id, ts_us) covers more than a share of the box (track_id)."""
    key = ["camera_id", "ts_us"]
    own = boxes.select(*key, "track_id", "x1", "y1", "x2", "y2")
    pairs = meeting(own, own, key).where(F.col("track_id") != F.col("r_track_id"))
    w, h = F.least("x2", "r_x2") - F.greatest("x1", "r_x1"), F.least("y2", "r_y2") - F.greatest("y1", "r_y1")
    covered = pairs.where(w * h > share * (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).select(*key, "track_id").distinct().withColumn("occluded", F.lit(True))
    return boxes.join(covered, [*key, "track_id"], "left").withColumn("occluded", F.coalesce("occluded", F.lit(False)))

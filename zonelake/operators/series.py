"""Time-weighted statistics of sparse readings: a reading stands until the next one, and unobserved time is not zero.

Readings have (camera_id, zone_id, ts_us, seq) and value columns. Rows of a window are those in (t0, t1]; the last one
at or before t0 (latest time, then latest arrival) opens it. A reading is trusted for max_hold_us at most, outages of its
camera are cut out, and what remains are pieces of observed time from which all figures follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonelake.operators import intervals as iv

KEY = ["camera_id", "zone_id"]


def place_of(order: list[str]) -> Column:
    """One or two whole numbers as one decimal of the same order: unlike a structure, its maximum is kept in a hash table, so rows are
    combined before the shuffle without a sort. A null comes before all numbers."""
    low = F.lit(-(2**62))
    first, *rest = (F.coalesce(F.col(c).cast("long"), low).cast("decimal(19,0)") for c in order)
    for other in rest:
        first = first * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + other
    return first.cast("decimal(38,0)")


def winners(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by one or two whole numbers. The last place is found first; rows meet it by key and place, and of copies
    in one place, one stays."""
    placed = rows.withColumn("__place", place_of(order))
    last = placed.groupBy(*keys).agg(F.max("__place").alias("__last")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__last")
    on = F.col("__place") == F.col("__last")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    one = F.row_number().over(Window.partitionBy(*keys).orderBy("__place"))
    return placed.join(last, on).withColumn("__copy", one).where("__copy = 1").select(*rows.columns)


def latest(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The latest row of each key, by time and then arrival."""
    return winners(rows, keys, ["ts_us", "seq"])


def window_rows(readings: DataFrame, t0: int, t1: int) -> DataFrame:
    """Rows in (t0, t1] and the opening row of each key, marked by ``opening``."""
    inside = readings.where((F.col("ts_us") > t0) & (F.col("ts_us") <= t1)).withColumn("opening", F.lit(False))
    opening = latest(readings.where(F.col("ts_us") <= t0)).withColumn("opening", F.lit(True))
    return inside.unionByName(opening)


def segments(readings: DataFrame, t0: int, t1: int, span: tuple[int, int] | None = None) -> DataFrame:
    """The rows of a window with the interval [a_us, b_us) that each describes (b_us may equal a_us), within span if
    that is wider than the window."""
    start, end = span or (t0, t1)
    held = iv.hold_forward(window_rows(readings, t0, t1), KEY)
    spans = held.withColumn("a_us", F.greatest("ts_us", F.lit(start))).withColumn("b_us", F.least(F.coalesce("next_us", F.lit(end)), F.lit(end)))
    return spans.where("b_us >= a_us").drop("next_us")


def trusted(rows: DataFrame, max_hold_us: int | None) -> DataFrame:
    """Cuts what a reading describes to the time that it may stand for."""
    if not max_hold_us:
        return rows
    return rows.withColumn("b_us", F.least("b_us", F.col("a_us") + max_hold_us))


def pieces(readings: DataFrame, outages: DataFrame, t0: int, t1: int, max_hold_us: int | None, span: tuple[int, int] | None = None) -> DataFrame:
    """Observed pieces [a_us, b_us) with the values of their reading."""
    rows = trusted(segments(readings, t0, t1, span), max_hold_us).where("b_us > a_us")
    return iv.subtract(rows, iv.merge(outages, ["camera_id"]), ["camera_id"])


def time_weighted(readings: DataFrame, outages: DataFrame, t0: int, t1: int, fields: list[str], max_hold_us: int | None) -> DataFrame:
    """Per key: samples, observed_us, coverage, and for each field its mean weighted by observed time, peak and minimum.

    Peak and minimum count every reading, also those of no observed time. Without max_hold_us the whole window but for
    outages counts as observable.
    """
    rows = iv.observed(trusted(segments(readings, t0, t1), max_hold_us), iv.merge(outages, ["camera_id"]), ["camera_id"])
    length, once = F.col("seen_us"), F.col("once")
    weigh = lambda f: F.sum(F.col(f) * length) / F.sum(F.when(F.col(f).isNotNull() & (length > 0), length))
    figures = [x for f in fields for x in (weigh(f).alias(f"mean_{f}"), F.max(f).alias(f"peak_{f}"), F.min(f).alias(f"min_{f}"))]
    out = rows.groupBy(*KEY).agg(F.count_if(once).alias("samples"), F.sum(length).alias("__seen"), *figures)
    if max_hold_us:
        seen = F.col("__seen")
    else:
        blind = iv.merge(iv.clip(outages, t0, t1), ["camera_id"]).groupBy("camera_id").agg(F.sum(F.col("b_us") - F.col("a_us")).alias("__blind"))
        out = out.join(blind, "camera_id", "left")
        seen = F.lit(t1 - t0) - F.coalesce("__blind", F.lit(0))
    out = out.withColumn("observed_us", seen).withColumn("coverage", F.round(F.col("observed_us") / F.lit(float(t1 - t0)), 4))
    return out.select(*KEY, "samples", "observed_us", "coverage", *[f"{n}_{f}" for f in fields for n in ("mean", "peak", "min")])


def bucket_step(t0: int, t1: int, step_us: int | None = None, most: int = 1000) -> int:
    """The asked step or a sixtieth of the window, coarse enough for at most ``most`` buckets."""
    step = step_us or max((t1 - t0) // 60, 1_000_000)
    return step if (t1 - t0) / step <= most else -(-(t1 - t0) // (most - 1))


def bucket_series(readings: DataFrame, outages: DataFrame, t0: int, t1: int, step_us: int, field: str, max_hold_us: int | None) -> DataFrame:
    """Per key and epoch-aligned bucket: coverage, rows inside, time-weighted mean, and the peak of these rows and of the
    one carried into the bucket. Buckets at the edges aren't clipped; the last row holds to the end of the last one."""
    first = t0 - t0 % step_us
    last = first + -(-(t1 - first) // step_us) * step_us
    rows = window_rows(readings, t0, t1).where(F.col("ts_us") < last)
    observed = pieces(readings, iv.clip(outages, first, last), t0, t1, max_hold_us, (first, last))
    parts = observed.withColumn("bucket_us", F.explode(F.sequence(F.col("a_us") - F.pmod("a_us", F.lit(step_us)), F.col("b_us") - 1, F.lit(step_us))))
    span = F.least("b_us", F.col("bucket_us") + step_us) - F.greatest("a_us", "bucket_us")
    valued = F.sum(F.when(F.col(field).isNotNull(), span))
    weights = parts.groupBy(*KEY, "bucket_us").agg(F.sum(span).alias("__seen"), (F.sum(F.col(field) * span) / valued).alias(field))
    own = F.col("ts_us") - F.pmod("ts_us", F.lit(step_us))
    inside = rows.withColumn("bucket_us", F.when(F.col("opening"), first - step_us).otherwise(own))
    order = F.struct("ts_us", "seq")
    counts = inside.groupBy(*KEY, "bucket_us").agg(
        F.count("*").alias("samples"), F.max(field).alias("__peak"), F.max_by(F.struct(F.col(field).alias("v")), order).alias("__last")
    )
    # The grid has a row for each key and bucket, at most a thousand by key, so the carried row can be found along it.
    grid = rows.select(*KEY).distinct().withColumn("bucket_us", F.explode(F.sequence(F.lit(first), F.lit(last - step_us), F.lit(step_us))))
    early = counts.where(F.col("bucket_us") < first).groupBy(*KEY).agg(F.max_by("__last", "bucket_us").alias("__early"))
    line = grid.join(counts, [*KEY, "bucket_us"], "left").join(early, KEY, "left")
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("bucket_us").rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("__carried", F.coalesce(before, F.col("__early"))["v"]).join(weights, [*KEY, "bucket_us"], "left")
    return line.select(
        *KEY, "bucket_us", F.round(F.coalesce("__seen", F.lit(0)) / F.lit(float(step_us)), 4).alias("coverage"),
        F.coalesce("samples", F.lit(0)).alias("samples"), field, F.greatest("__peak", "__carried").alias(f"peak_{field}"),
    )


def state_at(readings: DataFrame, at: list[int], max_hold_us: int | None) -> DataFrame:
    """Per key and instant the reading in force, its age, and whether it is older than max_hold_us; instants before
    the first reading have no row. asof.zone_at() is the same for a table of instants, with the camera's outages."""
    from zonelake.operators.asof import as_of

    asked = readings.select(*KEY).distinct().withColumn("at_us", F.explode(F.array(*[F.lit(t).cast("long") for t in at])))
    found = as_of(asked, readings, KEY).where("found IS NOT NULL")
    found = found.select(*[(F.col(c) if c in KEY else F.col(f"found.{c}")) for c in readings.columns], "at_us")
    found = found.withColumn("age_us", F.col("at_us") - F.col("ts_us"))
    return found.withColumn("stale", F.col("age_us") > max_hold_us if max_hold_us else F.lit(False))


def episodes(readings: DataFrame, outages: DataFrame, t0: int, t1: int, condition: Column, max_hold_us: int | None) -> DataFrame:
    """(key, a_us, b_us): observed stretches in which the condition held."""
    return iv.merge(pieces(readings, outages, t0, t1, max_hold_us).where(F.coalesce(condition, F.lit(False))), KEY)


def duration_where(readings: DataFrame, outages: DataFrame, t0: int, t1: int, condition: Column, max_hold_us: int) -> DataFrame:
    """Per key: how long the condition held, in how many episodes, the longest, and the time not observed."""
    found = episodes(readings, outages, t0, t1, condition, max_hold_us)
    length = F.col("b_us") - F.col("a_us")
    sums = found.groupBy(*KEY).agg(F.sum(length).alias("total_us"), F.count("*").alias("episode_count"), F.max(length).alias("longest_us"))
    seen = iv.observed(trusted(segments(readings, t0, t1), max_hold_us), iv.merge(outages, ["camera_id"]), ["camera_id"])
    out = seen.groupBy(*KEY).agg(F.sum("seen_us").alias("__seen")).join(sums, KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    unseen = F.lit(t1 - t0) - zero("__seen")
    return out.select(*KEY, zero("total_us").alias("total_us"), zero("episode_count").alias("episode_count"), zero("longest_us").alias("longest_us"), unseen.alias("unobserved_us"), F.round((F.lit(t1 - t0) - unseen) / F.lit(float(t1 - t0)), 4).alias("coverage"))


def find_gaps(readings: DataFrame, outages: DataFrame, t0: int, t1: int, max_hold_us: int) -> DataFrame:
    """(key, a_us, b_us, reason): outages of the camera, and silence longer than max_hold_us outside of these."""
    rows = segments(readings, t0, t1)
    silent = rows.withColumn("a_us", F.col("a_us") + max_hold_us).where("b_us > a_us").select(*KEY, "a_us", "b_us")
    lead_in = rows.groupBy(*KEY).agg(F.min("a_us").alias("b_us")).where(F.col("b_us") > t0).select(*KEY, F.lit(t0).alias("a_us"), "b_us")
    known = iv.merge(iv.clip(outages, t0, t1), ["camera_id"])
    no_data = iv.merge(iv.subtract(silent.union(lead_in), known, ["camera_id"]), KEY).withColumn("reason", F.lit("no_data"))
    offline = rows.select(*KEY).distinct().join(known, "camera_id").select(*KEY, "a_us", "b_us", F.lit("camera_offline").alias("reason"))
    return no_data.select(*KEY, "a_us", "b_us", "reason").union(offline)

"""As-of joins: what was in force at each of many instants.

Instants and readings are one stream, cut into chunks of time by key; within a chunk a running last value gives each instant
the reading before it, and from chunk to chunk goes the last reading only. So a reading stays one row however many instants follow it, an
instant stays one row however many readings precede it, and a key with a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelake.operators import intervals as iv


def kind_of(rows: DataFrame, columns: list[str]):
    return rows.select(F.struct(*columns).alias("s")).schema["s"].dataType


def as_of(instants: DataFrame, rows: DataFrame, keys: list[str], into: str = "found", at: str = "at_us", ts: str = "ts_us", seq: str = "seq", chunk_us: int = iv.DAY) -> DataFrame:
    """Adds the struct ``into`` of the row of rows in force at each instant: the last one of the key at or before it by time
    and then arrival, null if there is none. An instant that is null, or whose key is, has none; the instants' columns stay as they are."""
    own, others = instants.columns, [c for c in rows.columns if c not in keys]
    given = instants.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__seq"), F.struct(*own).alias("__left"), F.lit(None).cast(kind_of(rows, others)).alias("__right"))
    read = rows.dropna(subset=keys).select(*keys, F.col(ts).alias("__t"), F.lit(0).alias("__kind"), F.col(seq).cast("long").alias("__seq"), F.lit(None).cast(kind_of(instants, own)).alias("__left"), F.struct(*others).alias("__right"))
    chunk = F.floor(F.col("__t") / chunk_us).alias("__chunk")
    both = read.unionByName(given).select("*", chunk)
    order = ["__t", "__kind", "__seq"]
    inside = F.last("__right", ignorenulls=True).over(Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # One carried row for each chunk with readings; a chunk with instants comes before its own end.
    place = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(F.desc("__t"), F.desc("__seq")))
    ends = read.select("*", chunk).withColumn("__place", place).where("__place = 1").select(*keys, "__chunk", F.lit(1).alias("__kind"), "__right")
    asked = given.select(*keys, chunk).distinct().select("*", F.lit(0).alias("__kind"), F.lit(None).cast(kind_of(rows, others)).alias("__right"))
    before = F.last("__right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__chunk", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    carried = ends.unionByName(asked).withColumn("__carried", before).where("__kind = 0").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__chunk").alias("__c"), "__carried")
    met = both.withColumn("__inside", inside).where("__kind = 1")
    on = F.col("__chunk") == F.col("__c")
    for k in keys:
        on &= F.col(k) == F.col(f"__{k}")
    return met.join(carried, on, "left").select("__left.*", F.coalesce("__inside", "__carried").alias(into))


def covered(instants: DataFrame, spans: DataFrame, keys: list[str], into: str, at: str = "at_us", chunk_us: int = iv.DAY) -> DataFrame:
    """Adds whether an instant lies in any interval (a_us, b_us) of the key, both ends included: of merged intervals, only the
    last one that began can hold it."""
    merged = iv.merge(spans, keys).withColumn("seq", F.lit(0))
    found = as_of(instants, merged, keys, "__span", at, "a_us", "seq", chunk_us)
    return found.withColumn(into, F.coalesce(F.col("__span.b_us") >= F.col(at), F.lit(False))).drop("__span")


def zone_at(instants: DataFrame, readings: DataFrame, outages: DataFrame, max_hold_us: int | None, keys: tuple[str, ...] = ("camera_id", "zone_id")) -> DataFrame:
    """Instants (keys, at_us, ...) with the reading in force (state), its age, whether it is too old to speak for the instant (stale),
    whether the camera was down then, and whether it can be trusted; state and trust are null where nothing was read before."""
    found = covered(as_of(instants, readings, list(keys), "state"), outages, ["camera_id"], "camera_offline")
    found = found.withColumn("age_us", F.col("at_us") - F.col("state.ts_us"))
    found = found.withColumn("stale", F.when(F.col("state").isNotNull(), F.col("age_us") > max_hold_us if max_hold_us else F.lit(False)))
    return found.withColumn("trustworthy", ~(F.col("stale") | F.col("camera_offline")))

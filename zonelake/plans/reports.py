"""Rollups: movement, the occupancy report and its totals, and the summary of one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelake.operators import asof
from zonelake.operators import intervals as iv
from zonelake.operators.series import KEY


def movement(movements: DataFrame) -> DataFrame:
    """How many people went from one zone to another."""
    return movements.where("event_type = 'ZONE_TRANSITION'").groupBy("zone_from", "zone_to").agg(F.count("*").alias("n"))


def top_flows(movements: DataFrame, n: int = 15) -> DataFrame:
    return movement(movements).orderBy(F.desc("n"), "zone_from", "zone_to").limit(n)


def occupancy_report(weighted: DataFrame, sampled: DataFrame, alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per zone: weighted mean where there is one, else the plain mean; peaks, coverage, alerts of the zone."""
    counts = alerts.groupBy(*KEY).agg(F.count("*").alias("alert_count"))
    out = sampled.join(weighted.select(*KEY, "mean_occupancy", "mean_density", "coverage"), KEY, "left").join(counts, KEY, "left")
    out = out.join(F.broadcast(zones.select(*KEY, "zone_name")), KEY, "left")
    return out.select(
        *KEY, "zone_name", F.round(F.coalesce("mean_occupancy", "avg_occupancy"), 6).alias("avg_occupancy"), F.round("avg_occupancy", 6).alias("sampled_avg_occupancy"), "peak_occupancy",
        F.round(F.coalesce("mean_density", "avg_density"), 6).alias("avg_density"), "peak_density", "coverage", F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
    )


def totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("zones"), F.min("coverage").alias("min_coverage"), F.sum("peak_occupancy").alias("total_peak"), F.max("peak_density").alias("max_density"), F.sum("alert_count").alias("total_alerts"))


def snapshot(live: DataFrame) -> DataFrame:
    """Total and peak over the live rows; 0 without any."""
    return live.agg(F.coalesce(F.sum("occupancy"), F.lit(0)).alias("total_occupancy"), F.coalesce(F.max("occupancy"), F.lit(0)).alias("peak_occupancy"), F.count("*").alias("zones"))


def summary(live: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: zones by status, people in zones (null without zones), alerts by severity."""
    zones = live.agg(F.sum("occupancy").alias("people_in_zones"), *[F.count_if(F.col("status") == s).alias(f"zones_{s.lower()}") for s in ("NORMAL", "WARNING", "CRITICAL")])
    severe = alerts.agg(*[F.count_if(F.col("severity") == s).alias(f"alerts_{s.lower()}") for s in ("RED", "AMBER", "INFO")])
    return zones.join(F.broadcast(severe))


def csv_ready(report: DataFrame) -> DataFrame:
    """Rounded to two places and in zone order, for ``write.csv(header=True, nullValue='')``."""
    kinds = dict(report.dtypes)
    return report.select(*[F.round(c, 2).alias(c) if kinds[c] == "double" else F.col(c) for c in report.columns]).orderBy(*KEY)


def chart(rows: DataFrame, label: str, dataset: str, value: str) -> DataFrame:
    """Long rows as one row per dataset with aligned arrays of labels and values; numbers that aren't finite drop out."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value)) != float("inf")))
    points = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(value).alias("v"))))
    return finite.groupBy(F.col(dataset).alias("dataset")).agg(points.alias("p")).select("dataset", F.col("p.l").alias("labels"), F.col("p.v").alias("data"))


#: What a chart may hold.
MAX_DATASETS, MAX_POINTS = 8, 1000


def shared_charts(rows: DataFrame, label: str, dataset: str, value: str) -> DataFrame:
    """(dataset, labels, data): the first MAX_DATASETS datasets over the same first MAX_POINTS labels; where a dataset has no number for a
    label, or one that isn't finite, its data is null, so a line breaks there and nothing shifts. Of several numbers the largest counts."""
    number = F.col(value).cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    points = rows.where(F.col(label).isNotNull()).groupBy(F.col(dataset).alias("dataset"), F.col(label).alias("label")).agg(F.max(finite).alias("v"))
    # Both lists are capped before they are gathered.
    labels = points.select("label").distinct().orderBy("label").limit(MAX_POINTS).agg(F.array_sort(F.collect_list("label")).alias("labels"))
    sets = points.select("dataset").distinct().orderBy("dataset").limit(MAX_DATASETS)
    kept = points.join(F.broadcast(sets), "dataset").join(F.broadcast(labels), F.array_contains("labels", F.col("label")))
    made = kept.groupBy("dataset", "labels").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("__by"))
    return made.select("dataset", "labels", F.transform("labels", lambda x: F.element_at("__by", x)).alias("data"))


def series_charts(series: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, chart, dataset, labels, data, value) from a bucketed series: mean and peak occupancy over time, nulls kept where nothing was observed, at most
    MAX_POINTS buckets; a tile of the observed share, in percent, where it is under 99.9. Zones without any mean have no chart."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy("bucket_us"))
    # Both in one aggregate, so the series is made once.
    shown = F.when(F.col("__place") <= MAX_POINTS, F.struct("bucket_us", F.round("occupancy", 2).alias("mean"), "peak_occupancy"))
    figures = F.array_sort(F.collect_list(shown)).alias("p"), F.avg("coverage").alias("coverage"), F.count("occupancy").alias("__n")
    every = series.withColumn("__place", place).groupBy(*key).agg(*figures).where("__n > 0")
    none = F.lit(None)
    line = lambda name, field: F.struct(F.lit("occupancy").alias("chart"), F.lit(name).alias("dataset"), F.col("p.bucket_us").alias("labels"), F.transform("p", lambda x: x[field].cast("double")).alias("data"), none.cast("double").alias("value"))
    tile = F.struct(F.lit("coverage").alias("chart"), none.cast("string").alias("dataset"), none.cast("array<long>").alias("labels"), none.cast("array<double>").alias("data"), F.round(F.col("coverage") * 100, 1).alias("value"))
    charts = F.array(line("mean", "mean"), F.when(F.exists("p", lambda x: x["peak_occupancy"] > 0), line("peak", "peak_occupancy")), F.when(F.col("coverage") < 0.999, tile))
    return every.select(*key, F.inline(F.array_compact(charts)))


def report_records(reports: DataFrame, kind: str, generated_us: int, t0: int, t1: int) -> DataFrame:
    """One stored report a scope of rows (scope, ...): (kind, generated_us, from_us, to_us, scope, payload as JSON)."""
    body = F.to_json(F.struct(*[c for c in reports.columns if c != "scope"]), {"ignoreNullFields": "false"})
    return reports.groupBy("scope").agg(F.array_sort(F.collect_list(body)).alias("rows")).select(
        F.lit(kind).alias("kind"), F.lit(generated_us).cast("long").alias("generated_us"), F.lit(t0).cast("long").alias("from_us"), F.lit(t1).cast("long").alias("to_us"), "scope",
        F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("payload"))


def list_reports(stored: DataFrame, limit: int = 100) -> DataFrame:
    """The newest stored reports, without what they contain."""
    return stored.drop("payload").orderBy(F.desc("generated_us"), "scope").limit(limit)


def get_report(stored: DataFrame, scope: str, generated_us: int, schema: str) -> DataFrame:
    """The rows of one stored report."""
    one = stored.where((F.col("scope") == scope) & (F.col("generated_us") == generated_us))
    return one.select(F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r")).select("r.*")


def due(last_us: int | None, now_us: int, every_us: int) -> bool:
    """Whether a scheduled report is to be made: at the first time, and once its period is over."""
    return last_us is None or now_us - last_us >= every_us


def schedule(requests: DataFrame, scopes: DataFrame, t0: int, t1: int, every_us: int, scope: str = "camera_id") -> DataFrame:
    """When reports of each scope are made in [t0, t1]: (scope, at_us, trigger). A request (scope, ts_us) makes one on demand; the
    scheduled one is due at t0, if nobody asks then, and every_us after the last report of either kind. Requests of one instant are one.

    What follows a request depends on the next one only, so no state runs along a scope."""
    asked = requests.where(F.col("ts_us").between(t0, t1)).select(scope, "ts_us").dropna().distinct().withColumn("trigger", F.lit("on_demand"))
    start = scopes.select(scope).distinct().select(scope, F.lit(t0).cast("long").alias("ts_us"))
    begun = start.join(asked, [scope, "ts_us"], "left_anti").withColumn("trigger", F.lit("scheduled"))
    rows = iv.hold_forward(asked.unionByName(begun), [scope], seq="ts_us", into="next_us")
    last = F.coalesce(F.col("next_us") - 1, F.lit(t1))
    due = F.when(F.col("ts_us") + every_us <= last, F.sequence(F.col("ts_us") + every_us, last, F.lit(every_us).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    made = F.concat(F.array(F.struct(F.col("ts_us").alias("at_us"), "trigger")), F.transform(due, lambda t: F.struct(t.alias("at_us"), F.lit("scheduled").alias("trigger"))))
    return rows.select(scope, F.inline(made))


def snapshots(instants: DataFrame, readings: DataFrame, scope: str = "camera_id") -> DataFrame:
    """Rule R-08: for each report (scope, at_us, ...) how many zones of the scope had reported, the people in them, and those in the fullest."""
    zones = readings.select(*KEY).distinct()
    asked = instants.join(zones, scope, "left")
    found = asof.as_of(asked, readings.select("seq", "ts_us", *KEY, "occupancy"), KEY, "__live")
    people, zero = F.col("__live.occupancy"), F.lit(0)
    return found.groupBy(*instants.columns).agg(
        F.count("__live").alias("zones"), F.coalesce(F.sum(people), zero).alias("total_occupancy"), F.coalesce(F.max(people), zero).alias("peak_occupancy")
    )

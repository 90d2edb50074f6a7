"""Queries of what a service answers: tools by name, charts, identity lists, candidates, sinks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonelake.operators import folds, health, identity, tracks
from zonelake.plans import domain as d
from zonelake.plans import reports, tools
from zonelake.plans.queries import ALERTS, BOXES, EPISODES, HEALTH, HEALTH_SQL, HOLD, HOUR, ORACLES, QUERIES, T0, T1, W, WEEK, alerts_of, boxes, marks, query, raw_events, stream_folder
from zonelake.streaming import sinks

#: What tools look back from.
NOW = T1


def site(spark: SparkSession, sf_dir: str) -> tools.Site:
    return tools.Site(d.states(spark, sf_dir), d.camera_events(spark, sf_dir), alerts_of(spark, sf_dir), d.zones(spark), HOLD)


DAY0 = T1 - 24 * HOUR
ONE_ZONE = "camera_id = 'CAM-01' AND zone_id = 'ZONE-02'"
LAST_DAY = lambda sql: sql.replace(str(T0), str(DAY0)).replace(repr(WEEK), repr(24.0 * HOUR)).replace(str(T1 - T0), str(24 * HOUR))


@query(LAST_DAY(f"""{EPISODES.replace("occupancy >= 8", "status = 'CRITICAL'")}, dd AS (SELECT camera_id, zone_id, CAST(sum(b_us - a_us) AS BIGINT) AS total_us, count(*) AS episode_count, max(b_us - a_us) AS longest_us FROM ep GROUP BY 1, 2),
se AS (SELECT camera_id, zone_id, CAST(sum(secs) AS BIGINT) AS seen FROM tw GROUP BY 1, 2)
SELECT se.camera_id, se.zone_id, coalesce(total_us, 0) AS total_us, coalesce(episode_count, 0) AS episode_count, coalesce(longest_us, 0) AS longest_us, {T1 - T0} - seen AS unobserved_us, round(seen / {WEEK}, 4) AS coverage
FROM se LEFT JOIN dd ON se.camera_id = dd.camera_id AND se.zone_id = dd.zone_id WHERE se.camera_id = 'CAM-01' AND se.zone_id = 'ZONE-02'"""))
def tool_zone_duration(spark, sf_dir):
    """A day back by default; the status is meant although a comparison came with it, and nulls aren't there."""
    return tools.run(site(spark, sf_dir), "zone_duration", {"zone_id": "ZONE-02", "camera_id": "CAM-01", "status": "critical", "field": "occupancy", "op": "gte", "value": 1, "hours": None}, NOW)


@query(f"""{W}, {ALERTS} SELECT * FROM al WHERE ts_us BETWEEN {T1 - 24 * HOUR} AND {T1} AND camera_id = 'CAM-01' AND status = 'OPEN' ORDER BY ts_us DESC, seq DESC LIMIT 100""")
def tool_alerts(spark, sf_dir):
    return tools.run(site(spark, sf_dir), "alerts", {"camera_id": "cam-01", "status": "open", "severity": None}, NOW)


@query(f"""{W}, ce2 AS (SELECT max(ts_us) AS t FROM ce WHERE camera_id = 'CAM-01' AND ts_us <= {T1}), x AS (SELECT *, row_number() OVER (ORDER BY ts_us DESC, seq DESC) AS rn FROM st WHERE {ONE_ZONE} AND ts_us <= {T1})
SELECT camera_id, zone_id, CAST({T1} AS BIGINT) AS at_us, seq, occupancy, {T1} - ts_us > {HOLD} AS stale, (SELECT event_type FROM ce WHERE camera_id = 'CAM-01' AND ts_us = (SELECT t FROM ce2)) = 'CAMERA_OFFLINE' AS camera_offline FROM x WHERE rn = 1""")
def tool_zone_at_time(spark, sf_dir):
    out = tools.run(site(spark, sf_dir), "zone_at_time", {"zone_id": "ZONE-02", "camera_id": "CAM-01"}, NOW)
    return out.select(*d.KEY, "at_us", "state.seq", "state.occupancy", "stale", "camera_offline")


@query(f"""{W}, x AS (SELECT *, row_number() OVER (PARTITION BY camera_id, zone_id ORDER BY ts_us DESC, seq DESC) AS rn FROM st WHERE camera_id = 'CAM-02') SELECT seq, ts_us, camera_id, zone_id, occupancy, density, capacity_pct, status FROM x WHERE rn = 1 AND ts_us >= {T1 + 18 * 24 * HOUR} - 30000000""")
def tool_live_state(spark, sf_dir):
    """An instant at which some zones of the camera have reported within half a minute, or none has."""
    return tools.run(site(spark, sf_dir), "live_state", {"camera_id": "CAM-02"}, T1 + 18 * 24 * HOUR)


@query(f"""WITH se AS ({ORACLES["bucket_series"]}), ag AS (SELECT camera_id, zone_id, avg(coverage) AS c, count(occupancy) AS n FROM se GROUP BY 1, 2 HAVING count(occupancy) > 0)
SELECT se.camera_id, se.zone_id, 'mean' AS dataset, count(*) AS points, count(occupancy) AS given, round(sum(round(occupancy, 2)), 4) AS total FROM se JOIN ag ON se.camera_id = ag.camera_id AND se.zone_id = ag.zone_id GROUP BY 1, 2
UNION ALL SELECT se.camera_id, se.zone_id, 'peak', count(*), count(peak_occupancy), CAST(sum(peak_occupancy) AS DOUBLE) FROM se JOIN ag ON se.camera_id = ag.camera_id AND se.zone_id = ag.zone_id GROUP BY 1, 2 HAVING max(peak_occupancy) > 0
UNION ALL SELECT camera_id, zone_id, 'coverage', NULL, NULL, round(c * 100, 1) FROM ag WHERE c < 0.999""")
def series_charts(spark, sf_dir):
    """Occupancy over time by zone as charts: points, how many of them are given, their sum, and the observed share as a tile."""
    shown = reports.series_charts(QUERIES["bucket_series"](spark, sf_dir))
    given = F.filter("data", lambda x: x.isNotNull())
    total = F.when(F.col("chart") == "coverage", F.col("value")).otherwise(F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), 4))
    return shown.select(*d.KEY, F.coalesce("dataset", "chart").alias("dataset"), F.size("labels").cast("long").alias("points"), F.when(F.col("data").isNotNull(), F.size(given).cast("long")).alias("given"), total.alias("total"))


@query(f"""{W}, p AS (SELECT camera_id || zone_id AS dataset, ts_us // {HOUR} AS label, max(CASE WHEN density > 3 THEN NULL ELSE density END) AS v FROM st GROUP BY 1, 2), ls AS (SELECT DISTINCT label FROM p ORDER BY 1 LIMIT 1000), ds AS (SELECT DISTINCT dataset FROM p ORDER BY 1 LIMIT 8)
SELECT dataset, (SELECT count(*) FROM ls) AS points, (SELECT min(label) FROM ls) AS first_label, count(v) AS given, round(sum(v), 6) AS total FROM p WHERE label IN (SELECT label FROM ls) AND dataset IN (SELECT dataset FROM ds) GROUP BY 1""")
def shared_charts(spark, sf_dir):
    """Eight datasets at most over the same thousand labels at most; what is missing or not finite is null in its place."""
    rows = d.states(spark, sf_dir).select(F.concat(*d.KEY).alias("dataset"), F.floor(F.col("ts_us") / HOUR).alias("label"), F.when(F.col("density") > 3, F.lit(float("nan"))).otherwise(F.col("density")).alias("v"))
    shown = reports.shared_charts(rows, "label", "dataset", "v")
    given = F.filter("data", lambda x: x.isNotNull())
    return shown.select("dataset", F.size("labels").cast("long").alias("points"), F.get("labels", F.lit(0)).alias("first_label"), F.size(given).cast("long").alias("given"), F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""{HEALTH_SQL}, ls AS (SELECT camera_id, arg_max(state, ts_us) AS state FROM hc WHERE ts_us <= {T1} AND state IS DISTINCT FROM previous GROUP BY 1)
SELECT count(*) AS cameras, count(*) FILTER (state = 'ONLINE') AS cameras_online, count(*) FILTER (state = 'DEGRADED') AS cameras_degraded, count(*) FILTER (state = 'RECONNECTING') AS cameras_reconnecting, count(*) FILTER (state = 'OFFLINE') AS cameras_offline, count(*) FILTER (state = 'DISABLED') AS cameras_disabled FROM ls""")
def summary_of_cameras(spark, sf_dir):
    """How many cameras were in each state at one instant, from their health."""
    return health.summary(health.at(health.changes(marks(spark, sf_dir), HEALTH), T1))


SCENE = "sc AS (SELECT *, (SELECT count(*) FROM ce WHERE ce.camera_id = st.camera_id AND event_type = 'CAMERA_ONLINE' AND ce.ts_us <= st.ts_us) AS scene FROM st)"


@query(f"{W}, {SCENE}, x AS (SELECT *, lag(status) OVER (PARTITION BY camera_id, zone_id, scene ORDER BY ts_us, seq) AS ps FROM sc) SELECT seq, camera_id, zone_id, status, scene FROM x WHERE ps IS NULL OR ps <> status")
def density_updates_by_scene(spark, sf_dir):
    """Every status is announced again after a camera came back."""
    rows = folds.scenes(d.states(spark, sf_dir), d.camera_events(spark, sf_dir))
    return folds.density_updates(rows, segment="scene").select("seq", *d.KEY, "status", "scene")


@query(f"{W}, {SCENE}, x AS (SELECT *, lag(status) OVER w AS ps, lag(occupancy) OVER w AS po FROM sc WINDOW w AS (PARTITION BY camera_id, zone_id, scene ORDER BY ts_us, seq)) SELECT seq, camera_id, zone_id, occupancy, scene FROM x WHERE ps IS NULL OR ps <> status OR po <> occupancy")
def change_gate_by_scene(spark, sf_dir):
    rows = folds.scenes(d.states(spark, sf_dir), d.camera_events(spark, sf_dir))
    return folds.gated(rows, 0, "scene").select("seq", *d.KEY, "occupancy", "scene")


@query(f"""{W}, x AS (SELECT *, lag(occupancy) OVER w AS po, lag(status) OVER w AS ps FROM st WINDOW w AS (PARTITION BY camera_id, zone_id ORDER BY ts_us, seq))
SELECT camera_id, ts_us // {24 * HOUR} AS day, count(*) AS readings, count(*) FILTER (po IS NULL OR occupancy <> po OR status <> ps) AS kept FROM x GROUP BY 1, 2""")
def rows_per_day(spark, sf_dir):
    """Growth by day, and what of it change-only storage keeps."""
    states, day = d.states(spark, sf_dir), F.floor(F.col("ts_us") / (24 * HOUR)).alias("day")
    kept = folds.gated(states, 0).groupBy("camera_id", day).agg(F.count("*").alias("kept"))
    return states.groupBy("camera_id", day).agg(F.count("*").alias("readings")).join(kept, ["camera_id", "day"], "left").fillna(0, ["kept"])


@query(f"{BOXES}, fr AS (SELECT camera_id, ts_us, count(*) AS n FROM bx GROUP BY 1, 2) SELECT camera_id, count(*) AS frames, round(avg(n), 6) AS mean_boxes, min(n) AS min_boxes, max(n) AS max_boxes FROM fr GROUP BY 1")
def boxes_per_frame(spark, sf_dir):
    return tracks.boxes_per_frame(boxes(spark, sf_dir))


SIGHTS = """sg AS (SELECT 'S' || (vec_id % 10) AS site_id, 'CAM-0' || (vec_id // 10 % 4) AS camera_id, vec_id AS track_id, vec_id * 5000000 AS ts_us, vec_id AS seq, 'g' || label AS global_ref, embedding FROM embeddings)"""


def sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings at ten sites with four cameras each, one after another in time."""
    v, text = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c.cast("string")
    return v.select(
        F.concat(F.lit("S"), text(F.col("vec_id") % 10)).alias("site_id"), F.concat(F.lit("CAM-0"), text(F.floor(F.col("vec_id") / 10) % 4)).alias("camera_id"), F.col("vec_id").alias("track_id"),
        (F.col("vec_id") * 5_000_000).alias("ts_us"), F.col("vec_id").alias("seq"), F.concat(F.lit("g"), text(F.col("label"))).alias("global_ref"), F.col("embedding").alias("vector"),
    )


@query(f"""WITH {SIGHTS}, p AS (SELECT a.site_id, a.camera_id AS from_camera, a.track_id AS from_track, a.seq AS from_seq, b.camera_id AS to_camera, b.track_id AS to_track, b.seq AS to_seq, b.ts_us - a.ts_us AS dt_us,
 list_cosine_similarity(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))) AS score, least(a.camera_id, b.camera_id) || greatest(a.camera_id, b.camera_id) AS pr
 FROM sg a JOIN sg b ON a.site_id = b.site_id AND a.seq < b.seq AND b.ts_us - a.ts_us BETWEEN 0 AND 300000000),
r AS (SELECT *, CASE WHEN from_camera = to_camera THEN 'same_camera' WHEN pr = 'CAM-00CAM-01' THEN CASE WHEN dt_us <= 250000000 THEN 'overlapping' END WHEN pr = 'CAM-01CAM-02' THEN CASE WHEN dt_us BETWEEN 60000000 AND 300000000 THEN 'transit_ok' END
 WHEN dt_us <= 120000000 THEN 'unknown_pair' END AS reason FROM p)
SELECT site_id, from_camera, from_track, from_seq, to_camera, to_track, to_seq, dt_us, reason, round(score, 6) AS score FROM r WHERE reason IS NOT NULL""")
def identity_candidates(spark, sf_dir):
    """Which earlier sightings of a site a sighting can be, by time and topology, and how alike they are."""
    topology = spark.createDataFrame([("CAM-00", "CAM-01", "OVERLAP", 0, 250_000_000), ("CAM-01", "CAM-02", "TRANSIT", 60_000_000, 300_000_000)], "a string, b string, kind string, min_us long, max_us long")
    return identity.candidates(sights(spark, sf_dir), topology).withColumn("score", F.round("score", 6))


@query(f"WITH {SIGHTS} SELECT site_id, global_ref, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT camera_id) AS cameras, count(*) AS sightings FROM sg GROUP BY 1, 2 HAVING count(DISTINCT camera_id) > 1")
def identity_list(spark, sf_dir):
    """People whom more than one camera of a site has seen."""
    return identity.listing(sights(spark, sf_dir), cross_camera_only=True)


@query(f"""WITH {SIGHTS}, m AS (SELECT *, CASE WHEN camera_id = lag(camera_id) OVER w THEN 0 ELSE 1 END AS nw FROM sg WINDOW w AS (PARTITION BY site_id, global_ref ORDER BY ts_us, seq)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY site_id, global_ref ORDER BY ts_us, seq) AS run FROM m) SELECT site_id, global_ref, camera_id, min(ts_us) AS from_us, max(ts_us) AS to_us, count(*) AS n FROM r GROUP BY site_id, global_ref, camera_id, run""")
def identity_journeys(spark, sf_dir):
    """Where each person of a site was, camera after camera."""
    return identity.journey(sights(spark, sf_dir))


@query(f"WITH {SIGHTS}, x AS (SELECT site_id, CASE WHEN global_ref IN ('g1', 'g3') THEN 'g0' ELSE global_ref END AS global_ref, camera_id FROM sg) SELECT site_id, global_ref, count(DISTINCT camera_id) AS cameras, count(*) AS sightings FROM x GROUP BY 1, 2")
def identities_merged(spark, sf_dir):
    """An operator says that two people are a third one."""
    pairs = spark.createDataFrame([("g0", "g1"), ("g0", "g3"), ("g2", "g2")], "keep string, drop string")
    return identity.listing(identity.merged(sights(spark, sf_dir), pairs)).select("site_id", "global_ref", "cameras", "sightings")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    """The last event of every user, kept by a stream in a bucketed table."""
    folder = stream_folder(spark)
    table = sinks.Table(spark, f"{folder}/table", "user_id long, event_id long, event_type string", ["user_id"], ["event_id"], 16)
    write = raw_events(spark, sf_dir).writeStream.foreachBatch(table.write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    write.awaitTermination()
    return table.read()


@query(f"""{W}, x AS (SELECT camera_id, ts_us, ts_us + {HOUR} AS b FROM ce WHERE event_type = 'CAMERA_OFFLINE') SELECT st.seq, st.camera_id, st.ts_us FROM st WHERE EXISTS (SELECT 1 FROM x WHERE x.camera_id = st.camera_id AND st.ts_us BETWEEN x.ts_us AND x.b)""")
def readings_near_outages(spark, sf_dir):
    """Readings within an hour after any of their camera's outages began; the hours overlap."""
    from zonelake.operators import asof

    spans = d.camera_events(spark, sf_dir).where("event_type = 'CAMERA_OFFLINE'").select("camera_id", F.col("ts_us").alias("a_us"), (F.col("ts_us") + HOUR).alias("b_us"))
    rows = d.states(spark, sf_dir).select("seq", "camera_id", F.col("ts_us").alias("at_us"))
    return asof.covered(rows, spans, ["camera_id"], "near").where("near").select("seq", "camera_id", F.col("at_us").alias("ts_us"))

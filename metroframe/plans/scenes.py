"""Queries over pixels, made from parts, and detections, made from events, as the tables have neither."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections, raster
from ..sources.tables import load
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

BANDS = {
    "x": "p_partkey % 50", "y": "(p_partkey - p_partkey % 50) / 50", "red": "(p_size * 37 + p_partkey) % 200 + 1", "nir": "p_partkey * 53 % 250 + 1",
    "blue": "p_partkey * 29 % 180 + 1", "green": "(p_size * 11 + p_partkey * 7) % 190 + 1", "later": "p_partkey * 71 % 250 + 1",
    "land": "p_size % 4", "land_later": "(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 4",
}
PIXELS = "SELECT p_partkey, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in BANDS.items()) + " FROM part"
SEEN = "SELECT event_id, event_type AS camera, user_id AS track, ts, value, CAST(event_id % 3 AS INT) AS roi, CASE event_id % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'person' ELSE 'bike' END AS label, (event_id * 37 % 101) / CAST(100 AS DOUBLE) AS confidence FROM events"
CLIP = "greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {}))"


def pixels(spark, folder):
    return load(spark, folder, "part").select("p_partkey", *(F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in BANDS.items()))


def seen(spark, folder):
    label = F.when(F.col("event_id") % 4 == 0, "car").when(F.col("event_id") % 4 == 1, "person").otherwise("bike")
    return load(spark, folder, "events").select("event_id", F.col("event_type").alias("camera"), F.col("user_id").alias("track"), "ts", "value", (F.col("event_id") % 3).cast("int").alias("roi"), label.alias("label"), (F.col("event_id") * 37 % 101 / 100.0).cast("double").alias("confidence"))


@query(f"""SELECT p_partkey, round({CLIP.format("(nir - red) / (nir + red)::DOUBLE")}, 6) AS ndvi, round({CLIP.format("(green - nir) / (green + nir)::DOUBLE")}, 6) AS ndwi,
    round({CLIP.format("2.5::DOUBLE * (nir - red) / nullif(nir + 6.0::DOUBLE * red - 7.5::DOUBLE * blue + 1, 0)")}, 6) * CASE WHEN nir + 6.0::DOUBLE * red - 7.5::DOUBLE * blue + 1 != 0 THEN 1 END + 0.0::DOUBLE AS evi FROM ({PIXELS})""")
def spectral_indices(spark, folder):
    nir, red, green, blue = (F.col(c) for c in ("nir", "red", "green", "blue"))
    found = {"ndvi": raster.normalised_difference(nir, red), "ndwi": raster.normalised_difference(green, nir), "evi": raster.enhanced_vegetation(nir, red, blue)}
    return pixels(spark, folder).select("p_partkey", *(F.round(v, 6).alias(n) for n, v in found.items()))


@query(f"WITH l AS (SELECT p_partkey, sqrt((later - nir)::DOUBLE ** 2 + (green - red)::DOUBLE ** 2) AS s FROM ({PIXELS})) SELECT p_partkey, round(s / (SELECT max(s) FROM l), 6) AS magnitude FROM l")
def change_vector(spark, folder):
    return raster.change_magnitude(pixels(spark, folder), [("nir", "later"), ("red", "green")]).select("p_partkey", F.round("magnitude", 6).alias("magnitude"))


@query(f"SELECT land AS before, land_later AS after, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY land)::DOUBLE, 6) AS share FROM ({PIXELS}) GROUP BY 1, 2")
def land_transitions(spark, folder):
    return raster.transitions(pixels(spark, folder), "land", "land_later").withColumn("share", F.round("share", 6))


@query(f"SELECT (floor(((degrees(atan2(y - cy, x - cx)) + 360.0) % 360.0) / 45.0) % 8)::INT AS direction, count(*) AS n FROM ({PIXELS} WHERE p_size % 4 = 3), (SELECT avg(x) AS cx, avg(y) AS cy FROM ({PIXELS} WHERE p_size % 4 = 3)) GROUP BY 1")
def growth_directions(spark, folder):
    return raster.directions(pixels(spark, folder).where("land = 3"), "x", "y")


@query(f"""WITH b AS (SELECT p_partkey, {raster.K2}::DOUBLE / ln({raster.K1}::DOUBLE / (nir / 20::DOUBLE) + 1) AS t FROM ({PIXELS})),
    k AS (SELECT p_partkey, round(t / (1 + {raster.PER_KELVIN!r}::DOUBLE * t * ln({raster.EMISSIVITY}::DOUBLE)), 4) AS kelvin FROM b), c AS (SELECT quantile_cont(kelvin, [0.5, 0.75, 0.9]) AS q FROM k)
    SELECT p_partkey, kelvin, (kelvin >= q[1])::INT + (kelvin >= q[2])::INT + (kelvin >= q[3])::INT AS level FROM k, c""")
def heat_levels(spark, folder):
    warm = pixels(spark, folder).select("p_partkey", F.round(raster.surface_kelvin(F.col("nir") / 20.0), 4).alias("kelvin"))
    return raster.levels(warm, "kelvin", [0.5, 0.75, 0.9])


@query(f"""WITH p AS ({PIXELS}), b AS (SELECT min(red) AS r, max(red) AS rr, min(green) AS g, max(green) AS gg, min(blue) AS l, max(blue) AS ll FROM p)
    SELECT p_partkey, round(0.5::DOUBLE * (red - r) / (rr - r) + 0.3::DOUBLE * (green - g) / (gg - g) + 0.2::DOUBLE * (blue - l) / (ll - l), 6) AS risk FROM p, b""")
def hazard_exposure(spark, folder):
    return raster.weighted_risk(pixels(spark, folder), {"red": 0.5, "green": 0.3, "blue": 0.2}).select("p_partkey", F.round("risk", 6).alias("risk"))


@query(f"""SELECT camera, track, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 3) AS seconds, count(*) AS n, round(avg(confidence), 6) AS confidence, CASE WHEN min(roi) != max(roi) THEN 'moving' ELSE 'stationary' END AS state
    FROM ({SEEN}) GROUP BY 1, 2 HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 86400 * 1e6""")
def persistent_tracks(spark, folder):
    found = detections.tracks(seen(spark, folder), ["camera", "track"], "ts", "roi", "confidence").where("seconds >= 86400")
    return found.select("camera", "track", F.round("seconds", 3).alias("seconds"), "n", F.round("confidence", 6).alias("confidence"), "state")


@query(f"SELECT camera, ts::DATE AS day, roi, count(DISTINCT track) AS n_tracks, CASE WHEN count(DISTINCT track) >= 8 THEN 'dense' ELSE 'busy' END AS level FROM ({SEEN}) GROUP BY 1, 2, 3 HAVING count(DISTINCT track) >= 3")
def roi_density(spark, folder):
    return detections.density(seen(spark, folder), [F.col("camera"), F.to_date("ts").alias("day"), F.col("roi")], "track", {"busy": 3, "dense": 8})


@query(f"SELECT camera, ts::DATE AS day, count(*) FILTER (label = 'car') AS n_car, count(*) FILTER (label = 'person') AS n_person FROM ({SEEN}) GROUP BY 1, 2 HAVING count(*) FILTER (label = 'car') >= 2 AND count(*) FILTER (label = 'person') >= 1")
def object_composition(spark, folder):
    return detections.composition(seen(spark, folder), [F.col("camera"), F.to_date("ts").alias("day")], "label", {"car": 2, "person": 1})


@query(f"""SELECT * FROM (SELECT event_id, round((CASE WHEN confidence >= 0.6 THEN 0.5 ELSE 0 END + CASE WHEN roi = 1 THEN 0.3 ELSE 0 END + CASE WHEN label = 'car' THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score, substr(sha1(event_id::VARCHAR), 1, 16) AS event_key FROM ({SEEN})) WHERE score >= 0.55""")
def template_events(spark, folder):
    methods = {"sure": (F.col("confidence") >= 0.6, 0.5), "inside": (F.col("roi") == 1, 0.3), "car": (F.col("label") == "car", 0.2)}
    return detections.template(seen(spark, folder), "event_id", methods, 0.55).select("event_id", F.round("score", 6).alias("score"), "event_key")


@query(f"SELECT camera, label, roi, count(DISTINCT track) AS n_tracks, min(ts) AS started, max(ts) AS ended, max(confidence) AS confidence, count(*) AS n_merged FROM ({SEEN}) GROUP BY 1, 2, 3")
def merged_events(spark, folder):
    return detections.merge(seen(spark, folder), ["camera", "label", "roi"], "track", "ts", "ts", "confidence")


@query(f"SELECT event_id, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'unsure' END, CASE WHEN roi = 2 AND label = 'person' THEN 'restricted' END, CASE WHEN value > 90 THEN 'extreme' END) AS reasons FROM ({SEEN}) WHERE confidence < 0.5 OR (roi = 2 AND label = 'person') OR value > 90")
def review_routing(spark, folder):
    rules = {"unsure": F.col("confidence") < 0.5, "restricted": (F.col("roi") == 2) & (F.col("label") == "person"), "extreme": F.col("value") > 90}
    return seen(spark, folder).select("event_id", detections.reasons(rules).alias("reasons")).where("reasons != ''")


@query(f"SELECT camera, round(avg(value), 2) AS score, CASE WHEN round(avg(value), 2) <= 0 THEN 'unavailable' WHEN round(avg(value), 2) < 55 THEN 'degraded' ELSE 'ok' END AS state, CASE WHEN round(avg(value), 2) <= 0 THEN 0.0 WHEN round(avg(value), 2) < 55 THEN 0.85 ELSE 1.0 END::DOUBLE AS weight FROM ({SEEN}) GROUP BY 1")
def camera_health(spark, folder):
    return detections.health(seen(spark, folder).groupBy("camera").agg(F.round(F.avg("value"), 2).alias("score")), "score")


@query(f"SELECT camera, unnest(generate_series(min(ts::DATE)::TIMESTAMP, max(ts::DATE)::TIMESTAMP, INTERVAL 6 HOUR)) AS frame_at FROM ({SEEN}) GROUP BY 1")
def sampled_frames(spark, folder):
    day = F.to_date("ts").cast("timestamp_ntz")
    spans = seen(spark, folder).groupBy("camera").agg(F.min(day).alias("started"), F.max(day).alias("ended"))
    return detections.sampled(spans, "started", "ended", "6 hours").select("camera", "frame_at")

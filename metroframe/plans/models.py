"""Queries with fitted models, warped trips, tracks and distances; regions, paths and boxes are made up from events' numbers, pixels from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import SLOTS, day_slot
from ..operators import models, near, patches, raster, tracking, warping
from ..sources.tables import load
from .activity import POINTS, events, points
from .patches import SIDE
from .registry import registry
from .scenes import PIXELS, pixels

QUERIES, ORACLE_SQL, query = registry()


def without_sql(f):
    """For queries that SQL can't say; tests compare their operators with plain loops."""
    QUERIES[f.__name__] = f
    return f


SEASON, HORIZON = 7, 3
_PLACE = f"(i % {SEASON}) + 1"


@query(f"""WITH RECURSIVE c AS (SELECT user_id % 20 AS region, ts::DATE AS d, sum(value) AS y FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY d DESC) <= 28),
    s AS (SELECT region, list(y ORDER BY d) AS y, list(d ORDER BY d) AS ds, count(*)::INT AS n FROM l GROUP BY 1 HAVING count(*) >= 3), b AS (SELECT *, n // {SEASON} AS whole FROM s),
    f(region, i, level, trend, seasonal) AS (SELECT region, 1, CASE WHEN n < {2 * SEASON} THEN y[1] ELSE list_sum(y[1:{SEASON}]) / {SEASON} END, CASE WHEN n < {2 * SEASON} THEN 0 ELSE (list_sum(y[{SEASON + 1}:{2 * SEASON}]) - list_sum(y[1:{SEASON}])) / {SEASON * SEASON} END,
            list_transform(range(0, {SEASON}), lambda k: coalesce(list_avg(list_transform(range(0, whole), lambda j: y[k + j * {SEASON} + 1])) - list_avg(y[1:whole * {SEASON}]), 0)) FROM b
        UNION ALL SELECT region, i + 1, v, CASE WHEN n < {2 * SEASON} THEN 0 ELSE 0.1::DOUBLE * (v - level) + 0.9::DOUBLE * trend END, list_transform(seasonal, lambda x, k: CASE WHEN n >= {2 * SEASON} AND k = {_PLACE} THEN 0.2::DOUBLE * (z - v) + 0.8::DOUBLE * x ELSE x END)
            FROM (SELECT f.*, n, y[i + 1] AS z, CASE WHEN n < {2 * SEASON} THEN 0.3::DOUBLE * y[i + 1] + 0.7::DOUBLE * level ELSE 0.3::DOUBLE * (y[i + 1] - seasonal[{_PLACE}]) + 0.7::DOUBLE * (level + trend) END AS v FROM f JOIN b USING (region) WHERE i < n))
    SELECT region, (ds[n] + ((ds[n] - ds[n - 1]) * h)::INT)::DATE AS day, h::INT AS step, round(CASE WHEN n < {2 * SEASON} THEN greatest(0, level) ELSE greatest(0, level + h * trend + seasonal[((n + h - 1) % {SEASON}) + 1]) END, 4) AS forecast, n AS history FROM f JOIN b USING (region), range(1, {HORIZON + 1}) r(h) WHERE i = n""")
def region_forecasts(spark, folder):
    """The next three days of each region, by Holt-Winters on its last four weeks."""
    counts = events(spark, folder).select((F.col("user_id") % 20).alias("region"), F.to_date("ts").alias("ts"), F.col("value").alias("y"))
    return models.region_forecasts(counts, SEASON, HORIZON).select("region", F.to_date("ts").alias("day"), "step", F.round("forecast", 4).alias("forecast"), "history")


def _features(rows, key, shares):
    total = F.count("*")
    return rows.groupBy(F.col(key).alias("id")).agg(F.array(*(F.count_if(s) / total for s in shares)).alias("features"))


STEPS = 8
_SLOT = "CASE " + " ".join(f"WHEN hour(ts) >= {a} AND hour(ts) < {b} THEN {i}" for i, (_, a, b) in list(enumerate(SLOTS))[1:]) + " ELSE 0 END"
_SHARES = ", ".join([f"count(*) FILTER (slot = {i}) / count(*)::DOUBLE" for i in range(7)] + [f"count(*) FILTER (event_type = '{t}') / count(*)::DOUBLE" for t in ("view", "click", "purchase")])


def _kmeans_sql():
    near_of = "(SELECT id, features, arg_min(c, (d, c)) AS c FROM (SELECT r.id, r.features, k.c, list_sum(list_transform(list_zip(r.features, k.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM rows r, {} k) GROUP BY 1, 2)"
    made = [f"p AS (SELECT *, {_SLOT} AS slot FROM events), rows AS MATERIALIZED (SELECT user_id AS id, [{_SHARES}] AS features FROM p GROUP BY 1), k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('42:' || id::VARCHAR), id) - 1 AS c, features FROM rows QUALIFY c < 4)"]
    for i in range(STEPS):
        mean = f"SELECT c, list(m ORDER BY i) AS features FROM (SELECT c, i, avg(v) AS m FROM (SELECT c, unnest(features) AS v, unnest(range(1, 11)) AS i FROM {near_of.format(f'k{i}')}) GROUP BY 1, 2) GROUP BY 1"
        made.append(f"k{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.features, k.features) AS features FROM k{i} k LEFT JOIN ({mean}) n USING (c))")
    return f"WITH {', '.join(made)} SELECT id, c::INT AS cluster, list_transform(features, lambda x: round(x, 6)) AS features FROM {near_of.format(f'k{STEPS}')}"


@query(_kmeans_sql())
def user_clusters(spark, folder):
    """Users by the shares of their hours and kinds of events, in four clusters."""
    slot = day_slot(F.hour("ts"))
    shares = [slot == name for name, *_ in SLOTS] + [F.col("event_type") == t for t in ("view", "click", "purchase")]
    rows = _features(events(spark, folder), "user_id", shares)
    found, _ = models.kmeans(rows, 4, 42, STEPS)
    return found.join(rows, "id").select("id", "cluster", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


_TWO = "(SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS g, ts::DATE AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2)"


@query(f"""WITH w AS (SELECT ds, max(y) FILTER (g = 'even') AS a, max(y) FILTER (g = 'odd') AS b FROM {_TWO} GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY ds) AS i FROM w),
    g AS (SELECT *, last_value(CASE WHEN a IS NOT NULL THEN i END IGNORE NULLS) OVER p AS a0, first_value(CASE WHEN a IS NOT NULL THEN i END IGNORE NULLS) OVER q AS a1, last_value(a IGNORE NULLS) OVER p AS av, first_value(a IGNORE NULLS) OVER q AS aw,
        last_value(CASE WHEN b IS NOT NULL THEN i END IGNORE NULLS) OVER p AS b0, first_value(CASE WHEN b IS NOT NULL THEN i END IGNORE NULLS) OVER q AS b1, last_value(b IGNORE NULLS) OVER p AS bv, first_value(b IGNORE NULLS) OVER q AS bw FROM i
        WINDOW p AS (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT ds, coalesce(a, av + (aw - av) * (i - a0) / nullif(a1 - a0, 0)::DOUBLE, av, aw) AS a, coalesce(b, bv + (bw - bv) * (i - b0) / nullif(b1 - b0, 0)::DOUBLE, bv, bw) AS b FROM g),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, 0.5::DOUBLE * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS t FROM f),
    e AS (SELECT ds, greatest(0, (a - ma) * (a - ma) + (b - mb) * (b - mb) - pow((a - ma) * cos(t) + (b - mb) * sin(t), 2)) AS error FROM f, m), c AS (SELECT quantile_cont(error, 0.25) AS l, quantile_cont(error, 0.75) AS h FROM e)
    SELECT ds, round(error, 4) AS error, error > h + 3 * (h - l) AS anomaly FROM e, c""")
def component_anomalies(spark, folder):
    """Days on which two groups of users don't go together as they do."""
    name = F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    series = events(spark, folder).groupBy(name.alias("unique_id"), F.to_date("ts").alias("ds")).agg(F.count("*").cast("double").alias("y"))
    return models.component_anomalies(series, 1, 3.0).withColumn("error", F.round("error", 4))


@query(f"""WITH d AS (SELECT p_partkey, (red - nir)::DOUBLE AS a, (green - later)::DOUBLE AS b FROM ({PIXELS})), m AS (SELECT 0.5::DOUBLE * atan2(2 * sum(a * b), sum(a * a) - sum(b * b)) AS t FROM d),
    c AS (SELECT p_partkey, abs(a * cos(t) + b * sin(t)) AS c FROM d, m) SELECT p_partkey, round(c / (SELECT max(c) FROM c), 6) AS change FROM c""")
def component_change(spark, folder):
    found = models.component_change(pixels(spark, folder), "p_partkey", [("red", "nir"), ("green", "later")])
    return found.withColumn("change", F.round("change", 6))


@without_sql
def warped_trips(spark, folder):
    """The weeks that go most like the weeks of some users, by warping."""
    week = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (7 * 86400))
    rows = points(spark, folder).groupBy((F.col("user_id") * 10_000 + week).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lat", "lon"))).alias("s"))
    paths = rows.select("id", F.transform("s", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("path"))
    asked = [r["id"] for r in paths.where(F.floor(F.col("id") / 10_000) % 50 == 0).select("id").orderBy("id").limit(20).collect()]
    return warping.alike(paths, asked)


BOXES = "SELECT event_id, event_type AS camera, date_trunc('hour', ts) AS hour, (event_id * 53 % 640)::DOUBLE AS x, (event_id * 31 % 360)::DOUBLE AS y FROM events"


def boxes(spark, folder):
    x, y = (F.col("event_id") * 53 % 640).cast("double"), (F.col("event_id") * 31 % 360).cast("double")
    label = F.when(F.col("event_id") % 4 == 0, "car").when(F.col("event_id") % 4 == 1, "person").otherwise("bike")
    return events(spark, folder).select(
        F.col("event_type").alias("camera"), label.alias("label"), F.to_date("ts").alias("day"), "ts", F.col("event_id").alias("frame"), F.lit(1).alias("number"),
        (x - 10).alias("x1"), (y - 20).alias("y1"), (x + 10).alias("x2"), (y + 20).alias("y2"), (F.col("event_id") * 37 % 101 / 100.0).cast("double").alias("confidence"),
    )


@without_sql
def built_tracks(spark, folder):
    """Tracks of a day's detections of a camera and label."""
    keys = ("camera", "label", "day")
    return tracking.tracks(tracking.associate(boxes(spark, folder), 80.0, 6 * 3600.0, keys), 20.0, keys)


@query(f"""WITH b AS ({BOXES}) SELECT camera, hour, count(*) AS n, coalesce(max((SELECT count(*) FROM b o WHERE o.camera = b.camera AND o.hour = b.hour AND o.event_id < b.event_id AND sqrt(pow(o.x - b.x, 2) + pow(o.y - b.y, 2)) <= 60)), 0) > 0 AS near FROM b GROUP BY 1, 2""")
def near_objects(spark, folder):
    """Hours of a camera in which two objects are near each other."""
    rows = boxes(spark, folder).select("camera", F.date_trunc("hour", "ts").alias("hour"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return near.any_near(rows, ["camera", "hour"], "x", "y", 60.0).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_PATCHED = f"""l AS MATERIALIZED (SELECT id AS a, id + o AS b FROM m, (VALUES (1), (-1), ({SIDE}), (-{SIDE})) t(o) WHERE id + o IN (SELECT id FROM m)), r(a, b) AS (SELECT id, id FROM m UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), p AS MATERIALIZED (SELECT x, y, patch FROM m JOIN (SELECT a AS id, min(b) AS patch FROM r GROUP BY 1) USING (id))"""


@query(f"""WITH RECURSIVE a AS MATERIALIZED ({PIXELS}), h AS (SELECT max(y) AS h FROM a), old AS MATERIALIZED (SELECT x, y FROM a WHERE land = 3), m AS MATERIALIZED (SELECT x, y, y * {SIDE} + x AS id FROM a WHERE land_later >= 2 AND land != 3), {_PATCHED},
    s AS (SELECT DISTINCT patch, x + i AS x, y + j AS y FROM p, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(i, j)), e AS (SELECT s.* FROM s, h WHERE x BETWEEN 0 AND 49 AND y BETWEEN 0 AND h AND NOT EXISTS (SELECT 1 FROM p WHERE p.patch = s.patch AND p.x = s.x AND p.y = s.y)),
    o AS (SELECT patch, count(*) AS n, count(*) FILTER ((x, y) IN (SELECT (x, y) FROM old)) AS o FROM e GROUP BY 1), z AS (SELECT patch, count(*) AS n_pixels, floor(avg(x)) AS x, floor(avg(y)) AS y FROM p GROUP BY 1),
    d AS (SELECT patch, min(sqrt(pow(z.x - old.x, 2) + pow(z.y - old.y, 2))) * 30 AS distance_m FROM z, old GROUP BY 1)
    SELECT patch, n_pixels, round(coalesce(o, 0) / greatest(coalesce(n, 0), 1)::DOUBLE, 6) AS old_share, round(distance_m, 6) AS distance_m, CASE WHEN coalesce(o, 0) / greatest(coalesce(n, 0), 1)::DOUBLE >= 0.6 THEN 'infilling' WHEN distance_m >= 60 THEN 'leapfrog' ELSE 'edge-expansion' END AS pattern FROM z LEFT JOIN o USING (patch) LEFT JOIN d USING (patch)""")
def growth_patterns(spark, folder):
    """Whether new built-up ground fills gaps, goes on at an edge, or leaps away."""
    rows = pixels(spark, folder)
    height = (rows.agg(F.max("y")).first()[0] or 0) + 1
    new = patches.patches(rows.where("land_later >= 2 AND land != 3"), "x", "y")
    found = near.growth_patterns(new, rows.where("land = 3").select("x", "y"), 50, height, 30.0, leapfrog_m=60.0)
    return found.select("patch", "n_pixels", F.round("old_share", 6).alias("old_share"), F.round("distance_m", 6).alias("distance_m"), "pattern")


@query(f"""WITH RECURSIVE a AS MATERIALIZED ({PIXELS}), sh AS MATERIALIZED (SELECT x, y FROM a WHERE p_partkey % 97 = 0), d AS (SELECT a.x, a.y, min(sqrt(pow(a.x - sh.x, 2) + pow(a.y - sh.y, 2))) AS d FROM a LEFT JOIN sh ON true WHERE a.land >= 1 GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT x, y, y * {SIDE} + x AS id FROM d WHERE d IS NULL OR d * 30 > 150), {_PATCHED} SELECT patch, count(*) AS n_pixels, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y FROM p GROUP BY 1 HAVING count(*) >= 5""")
def shelter_gaps(spark, folder):
    """Patches at risk that no shelter covers."""
    rows = pixels(spark, folder)
    found = near.shelter_gaps(rows.where("land >= 1"), rows.where("p_partkey % 97 = 0").select("x", "y"), 150.0, 30.0, 5)
    return found.withColumn("centre_x", F.round("centre_x", 6)).withColumn("centre_y", F.round("centre_y", 6))


@query(f"""WITH p AS ({PIXELS}), s AS (SELECT avg(red) AS m, stddev_pop(red) AS d, avg(green) AS n, stddev_pop(green) AS e FROM p) SELECT p_partkey, (abs((red - m) / d) + abs((green - n) / e)) / 2 > 1.2 AS anomaly FROM p, s""")
def pixel_anomalies(spark, folder):
    return raster.z_anomalies(pixels(spark, folder), ["red", "green"], 1.2).select("p_partkey", "anomaly")


@query(f"""WITH RECURSIVE a AS MATERIALIZED ({PIXELS}), m AS MATERIALIZED (SELECT x, y, y * {SIDE} + x AS id FROM a WHERE red > 120 OR green > 150), {_PATCHED} SELECT patch, count(*) AS n_pixels, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y FROM p GROUP BY 1 HAVING count(*) >= 4""")
def water_hotspots(spark, folder):
    """Patches in which one of two measures is high."""
    found = patches.outlines(patches.patches(pixels(spark, folder).where("red > 120 OR green > 150"), "x", "y"), 4)
    return found.withColumn("centre_x", F.round("centre_x", 6)).withColumn("centre_y", F.round("centre_y", 6))

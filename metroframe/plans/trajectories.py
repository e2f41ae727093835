"""Queries over points of moving users; places are made up from numbers, as no table has any."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import meetings
from ..operators import trajectories as t
from .activity import DAILY, POINTS, daily, events, points
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
#: Cells of a hundredth of the area, by the same arithmetic in both engines.
CELLS = f"SELECT *, 'c' || floor((lat - 30) * 4)::INT || '_' || floor((lon - 120) * 4)::INT AS cell FROM ({POINTS})"
KM = "2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"


def cells(spark, folder):
    name = F.concat(F.lit("c"), F.floor((F.col("lat") - 30) * 4).cast("string"), F.lit("_"), F.floor((F.col("lon") - 120) * 4).cast("string"))
    return points(spark, folder).withColumn("cell", name)


@query(f"SELECT event_id FROM ({POINTS}) WHERE user_id IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, ts, round(lat, 7), round(lon, 7) ORDER BY event_id) = 1")
def single_points(spark, folder):
    """Every point twice, the second time with a greater number: the first stays."""
    rows = points(spark, folder)
    return t.once(rows.unionByName(rows.withColumn("event_id", F.col("event_id") + 10_000_000)), "user_id", "ts", "lat", "lon", "event_id").select("event_id")


def cleaned_points(spark, folder):
    """No SQL: each point depends on the last kept one; tests compare with a plain loop."""
    return t.without_jumps(points(spark, folder).select("user_id", "ts", "lat", "lon", "event_id"), "user_id", "ts", "lat", "lon", "event_id", 30.0)


def stay_points(spark, folder):
    """No SQL: each run begins where the last one ended; tests compare with a plain loop."""
    return t.stays(points(spark, folder), "user_id", "ts", "lat", "lon", "event_id", 60_000.0, 240.0)


QUERIES |= {"cleaned_points": cleaned_points, "stay_points": stay_points}

TRIPS = f"""t1 AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 720 * 6e7, true)::INT AS b FROM ({POINTS})), t2 AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS trip FROM t1),
    t3 AS (SELECT *, coalesce({KM.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS km FROM t2 WINDOW w AS (PARTITION BY user_id, trip ORDER BY ts, event_id)),
    t4 AS (SELECT user_id, trip, min(ts) AS started, max(ts) AS ended, count(*) AS points, sum(km) AS km, arg_min(lat, (ts, event_id)) AS la, arg_min(lon, (ts, event_id)) AS lo, arg_max(lat, (ts, event_id)) AS lb, arg_max(lon, (ts, event_id)) AS lp FROM t3 GROUP BY 1, 2 HAVING count(*) >= 3),
    trips AS (SELECT *, {KM.format('la', 'lo', 'lb', 'lp')} AS straight_km, (epoch_us(ended) - epoch_us(started)) / 6e7 AS minutes FROM t4)"""


def trips(spark, folder):
    return t.segmented(points(spark, folder), "user_id", "ts", "lat", "lon", "event_id", 720, 3)


@query(f"WITH {TRIPS} SELECT user_id, trip, started, ended, points, round(km, 4) AS km, round(minutes, 3) AS minutes, round(km / nullif(straight_km, 0), 4) AS detour FROM trips")
def trip_segments(spark, folder):
    return trips(spark, folder).select("user_id", "trip", "started", "ended", "points", F.round("km", 4).alias("km"), F.round("minutes", 3).alias("minutes"), F.round(F.try_divide(F.col("km"), F.col("straight_km")), 4).alias("detour"))


@query(f"WITH {TRIPS}, c AS (SELECT *, 'c' || floor((la - 30) * 2)::INT || '_' || floor((lo - 120) * 2)::INT AS origin, 'c' || floor((lb - 30) * 2)::INT || '_' || floor((lp - 120) * 2)::INT AS destination FROM trips) SELECT origin, destination, count(*) AS trips, round(avg(km), 4) AS mean_km, round(avg(minutes), 4) AS mean_minutes FROM c GROUP BY 1, 2")
def trip_flows(spark, folder):
    name = lambda p: F.concat(F.lit("c"), F.floor((F.col(f"{p}.lat") - 30) * 2).cast("string"), F.lit("_"), F.floor((F.col(f"{p}.lon") - 120) * 2).cast("string"))
    return trips(spark, folder).groupBy(name("a").alias("origin"), name("b").alias("destination")).agg(F.count("*").alias("trips"), F.round(F.avg("km"), 4).alias("mean_km"), F.round(F.avg("minutes"), 4).alias("mean_minutes"))


_ROBUST = "CASE WHEN n < 2 THEN 0 WHEN n < 5 OR mad = 0 THEN coalesce((value - mean) / nullif(sd, 0), 0) ELSE 0.6745::DOUBLE * (value - med) / mad END"


@query(f"""WITH {TRIPS}, v AS (SELECT user_id, user_id || '-' || trip AS trip_id, unnest(['km', 'minutes', 'kmh']) AS measure, unnest([km, minutes, km / nullif(minutes / 60, 0)]) AS value FROM trips), m AS (SELECT *, median(value) OVER (PARTITION BY user_id, measure) AS med, count(value) OVER (PARTITION BY user_id, measure) AS n,
    avg(value) OVER (PARTITION BY user_id, measure) AS mean, stddev_pop(value) OVER (PARTITION BY user_id, measure) AS sd FROM v WHERE value IS NOT NULL), d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY user_id, measure) AS mad FROM m), s AS (SELECT *, {_ROBUST} AS score FROM d)
    SELECT user_id, trip_id, measure, round(value, 4) AS value, round(abs(score), 4) AS score, CASE WHEN score > 0 THEN 'high' ELSE 'low' END AS side FROM s WHERE abs(score) >= 2 ORDER BY round(abs(score), 4) DESC, trip_id, measure LIMIT 20""")
def route_anomalies(spark, folder):
    rows = trips(spark, folder).select("user_id", F.concat_ws("-", "user_id", "trip").alias("trip_id"), "km", "minutes", F.try_divide(F.col("km"), F.col("minutes") / 60).alias("kmh"))
    return t.anomalies(rows, "user_id", "trip_id", ["km", "minutes", "kmh"], 2.0, 20)


@query(f"""WITH {DAILY}, m AS (SELECT unique_id, ds, y::DOUBLE AS value, median(y) OVER (PARTITION BY unique_id) AS med, count(y) OVER (PARTITION BY unique_id) AS n, avg(y) OVER (PARTITION BY unique_id) AS mean, stddev_pop(y) OVER (PARTITION BY unique_id) AS sd FROM series),
    d AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY unique_id) AS mad FROM m), s AS (SELECT *, {_ROBUST} AS score FROM d) SELECT unique_id, ds, 'y' AS measure, value, round(abs(score), 4) AS score, CASE WHEN score > 0 THEN 'high' ELSE 'low' END AS side FROM s WHERE abs(score) >= 1 ORDER BY round(abs(score), 4) DESC, ds, unique_id LIMIT 20""")
def flow_anomalies(spark, folder):
    rows = daily(spark, folder).withColumn("key", F.struct("ds", "unique_id"))
    return t.anomalies(rows, "unique_id", "key", ["y"], 1.0, 20).withColumn("ds", F.col("key.ds")).drop("key")


@query(f"""WITH {TRIPS}, v AS (SELECT user_id || '-' || trip AS trip_id, la, lo, lb, lp, km, minutes FROM trips), o AS (SELECT * FROM v WHERE trip_id = (SELECT min(trip_id) FROM v)), s AS (SELECT {', '.join(f'coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}' for c in ('la', 'lo', 'lb', 'lp', 'km', 'minutes'))} FROM v)
    SELECT v.trip_id, round(1 / (1 + sqrt({' + '.join(f'pow((v.{c} - o.{c}) / s_{c}, 2)' for c in ('la', 'lo', 'lb', 'lp', 'km', 'minutes'))})), 6) AS similarity FROM v, o, s WHERE v.trip_id != o.trip_id ORDER BY 2 DESC, 1 LIMIT 10""")
def similar_trips(spark, folder):
    rows = trips(spark, folder).select(F.concat_ws("-", "user_id", "trip").alias("trip_id"), F.col("a.lat").alias("la"), F.col("a.lon").alias("lo"), F.col("b.lat").alias("lb"), F.col("b.lon").alias("lp"), "km", "minutes")
    target = rows.agg(F.min("trip_id")).first()[0]
    return t.alike(rows, "trip_id", target, ["la", "lo", "lb", "lp", "km", "minutes"], 10)


@query(f"""WITH p AS ({CELLS}), c AS (SELECT cell, strftime(ts, '%Y-%m-%d') AS bucket, event_type, count(*) AS n FROM p GROUP BY 1, 2, 3), k AS (SELECT cell, bucket, sum(n)::BIGINT AS n, array_to_string(list_slice(list(event_type ORDER BY n DESC, event_type), 1, 5), ',') AS categories FROM c GROUP BY 1, 2)
    SELECT cell, bucket, users, n, categories FROM k JOIN (SELECT cell, strftime(ts, '%Y-%m-%d') AS bucket, count(DISTINCT user_id) AS users FROM p GROUP BY 1, 2) USING (cell, bucket)""")
def cell_heat(spark, folder):
    return t.cell_heat(cells(spark, folder), "user_id", "event_type", "ts", "cell", "day")


@query(f"""WITH m AS (SELECT *, lead(cell) OVER w AS c2, lead(ts) OVER w AS t2, lead(lat) OVER w AS la2, lead(lon) OVER w AS lo2 FROM ({CELLS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT cell AS origin, c2 AS destination, count(*) AS flow, count(DISTINCT user_id) AS users,
    round(avg((epoch_us(t2) - epoch_us(ts)) / 3.6e9), 7) AS mean_hours, round(avg(lat), 7) AS from_lat, round(avg(lon), 7) AS from_lon, round(avg(la2), 7) AS to_lat, round(avg(lo2), 7) AS to_lon FROM m WHERE c2 != cell GROUP BY 1, 2""")
def cell_flows(spark, folder):
    return t.flows(cells(spark, folder), "user_id", "ts", "cell", "lat", "lon", "event_id")


_SLOT = "CASE WHEN hour(ts) >= 23 OR hour(ts) < 7 THEN '凌晨' WHEN hour(ts) < 9 THEN '早高峰' WHEN hour(ts) < 11 THEN '上午' WHEN hour(ts) < 13 THEN '午间' WHEN hour(ts) < 17 THEN '下午' WHEN hour(ts) < 19 THEN '晚高峰' ELSE '夜间' END"


@query(f"""WITH p AS (SELECT *, ts::DATE AS day, {_SLOT} AS slot FROM ({CELLS})), c AS (SELECT day, slot, cell, event_type, count(*) AS m FROM p GROUP BY 1, 2, 3, 4), u AS (SELECT day, slot, cell, count(DISTINCT user_id) AS users, count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING users >= 2)
    SELECT day, slot, cell, users, n, array_to_string(list_slice(list(event_type || ':' || format('{{:.1f}}', round(100.0::DOUBLE * m / n, 1)) || '%' ORDER BY m DESC, event_type), 1, 3), ',') AS categories FROM c JOIN u USING (day, slot, cell) GROUP BY 1, 2, 3, 4, 5""")
def private_buckets(spark, folder):
    return t.private_buckets(cells(spark, folder), "user_id", "event_type", "ts", "cell", 2)


@query("""WITH s AS (SELECT event_type AS region, count(*) FILTER (d >= DATE '2024-01-03' AND d < DATE '2024-01-10') AS n_before, count(*) FILTER (d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS n_during, count(*) FILTER (d > DATE '2024-01-12' AND d <= DATE '2024-01-19') AS n_after FROM (SELECT event_type, ts::DATE AS d FROM events) GROUP BY 1),
    r AS (SELECT *, (n_during / 3.0::DOUBLE) / nullif(n_before / 7.0::DOUBLE, 0) AS ra FROM s) SELECT region, n_before, n_during, n_after, round(ra, 6) AS ratio, round((n_after / 7.0::DOUBLE) / nullif(n_before / 7.0::DOUBLE, 0), 6) AS recovery, CASE WHEN ra IS NULL THEN 'no_baseline' WHEN ra >= 1.2 THEN 'surge' WHEN ra <= 0.8 THEN 'drop' ELSE 'stable' END AS label FROM r""")
def labelled_impact(spark, folder):
    return t.impact(events(spark, folder), "event_type", "ts", "2024-01-10", "2024-01-12", 7)


@query(f"""WITH {DAILY}, p AS (SELECT unique_id, y, ds >= DATE '2024-01-16' AS after FROM series), s AS (SELECT unique_id, avg(y) FILTER (NOT after) AS a, avg(y) FILTER (after) AS b, var_samp(y) FILTER (NOT after) AS u, var_samp(y) FILTER (after) AS v, count(y) FILTER (NOT after) AS n, count(y) FILTER (after) AS m FROM p GROUP BY 1),
    t AS (SELECT *, (b - a) / nullif(sqrt(u / n + v / m), 0) AS t FROM s), k AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2)) AS k FROM t)
    SELECT unique_id, round(a, 6) AS pre_mean, round(b, 6) AS post_mean, round(t, 4) AS t, round(k * (0.254829592::DOUBLE + k * (-0.284496736::DOUBLE + k * (1.421413741::DOUBLE + k * (-1.453152027::DOUBLE + k * 1.061405429::DOUBLE)))) * exp(-t * t / 2), 5) AS p,
    round(b - a - (SELECT avg(b - a) FROM s WHERE unique_id != 'purchase'), 6) AS effect FROM k""")
def treated_effect(spark, folder):
    return t.effect(daily(spark, folder), ["purchase"], "2024-01-16")


_VISITS = f"SELECT user_id, cell, ts AS s, ts + to_seconds((300 + value * 60)::BIGINT) AS e FROM ({CELLS})"


def _visits(spark, folder):
    seconds = (300 + F.col("value") * 60)
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(seconds).cast("long") * 1_000_000)
    return cells(spark, folder).select("user_id", "cell", F.col("ts").cast("timestamp").alias("s"), end.alias("e"))


@query(f"""WITH v AS ({_VISITS}), m AS (SELECT x.cell, x.user_id AS a, y.user_id AS b, greatest(x.s, y.s) AS s, least(x.e, y.e) AS e FROM v x JOIN v y ON x.cell = y.cell AND x.user_id < y.user_id AND x.s < y.e AND y.s < x.e), o AS (SELECT *, round((epoch_us(e) - epoch_us(s)) / 6e7, 2) AS minutes FROM m WHERE epoch_us(e) - epoch_us(s) >= 15 * 6e7)
    SELECT a, b, count(*) AS times, round(sum(minutes), 2) AS minutes, string_agg(DISTINCT cell, ',' ORDER BY cell) AS cells FROM o GROUP BY 1, 2""")
def meeting_pairs(spark, folder):
    return meetings.meeting_pairs(_visits(spark, folder), "user_id", "cell", "s", "e", 15)


@query(f"""WITH v AS (SELECT *, strftime(ts, '%Y-%m-%d') AS bucket, 'k' || event_id % 3 AS f FROM ({CELLS})), s AS (SELECT cell AS region, bucket, round(sum(ln(1 + greatest(value, 0))), 4) AS fused, max(value) AS top, count(*) AS n FROM v GROUP BY 1, 2),
    f AS (SELECT cell AS region, bucket, f, count(*) AS n FROM v GROUP BY 1, 2, 3), l AS (SELECT cell AS region, bucket, event_type AS l, count(*) AS n FROM v GROUP BY 1, 2, 3)
    SELECT s.*, (SELECT string_agg(f || '=' || n, ',' ORDER BY n DESC, f) FROM f WHERE f.region = s.region AND f.bucket = s.bucket) AS f_counts, (SELECT array_to_string(list_slice(list(l || '=' || n ORDER BY n DESC, l), 1, 3), ',') FROM l WHERE l.region = s.region AND l.bucket = s.bucket) AS l_counts FROM s""")
def fused_evidence(spark, folder):
    rows = cells(spark, folder).withColumn("kind", F.concat(F.lit("k"), F.col("event_id") % 3))
    return t.fused(rows, "cell", "ts", "value", "kind", "event_type", "day")


@query(f"""WITH p AS ({CELLS}), k AS (SELECT *, coalesce({KM.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS km FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT user_id, count(*) AS points, sum(km) AS km, arg_min(lat, (ts, event_id)) AS la, arg_min(lon, (ts, event_id)) AS lo, arg_max(lat, (ts, event_id)) AS lb, arg_max(lon, (ts, event_id)) AS lp, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM k GROUP BY 1),
    c AS (SELECT user_id, count(*) AS cells, max(m) AS most FROM (SELECT user_id, cell, count(*) AS m FROM p GROUP BY 1, 2) GROUP BY 1), j AS (SELECT *, {KM.format('la', 'lo', 'lb', 'lp')} AS net, {KM.format('s', 'w', 'n', 'e')} AS span, most / points::DOUBLE AS share FROM g JOIN c USING (user_id)), d AS (SELECT *, coalesce(net / nullif(km, 0), 0) AS direct FROM j)
    SELECT user_id, points, round(km, 3) AS km, round(net, 3) AS net_km, round(direct, 3) AS directness, cells, round(share, 3) AS top_share, CASE WHEN points < 2 THEN 'insufficient_data' WHEN share >= 0.9 OR span < 0.2 THEN 'stationary' WHEN direct >= 0.7 AND span >= 3 THEN 'directed_migration' WHEN cells >= 5 AND direct < 0.3 THEN 'frequent_circulation' ELSE 'random_walk' END AS state FROM d""")
def movement_states(spark, folder):
    return t.movement_state(cells(spark, folder), "user_id", "ts", "lat", "lon", "event_id", "cell")

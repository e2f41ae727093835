"""Queries over the stream of events: time, place, sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import filters, relations, sequences, series, trends
from ..sources.tables import load
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
WHO = ("user_id", "event_type", "ts", "event_id")

DAILY = """counts AS (SELECT event_type AS unique_id, ts::DATE AS ds, count(*) AS y FROM events GROUP BY 1, 2),
    span AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY))::DATE AS ds FROM counts GROUP BY 1),
    series AS (SELECT unique_id, ds, coalesce(y, 0) AS y FROM span LEFT JOIN counts USING (unique_id, ds))"""
METRICS = """SELECT user_id, count(*) AS n_events, round(avg((hour(ts) >= 22 OR hour(ts) <= 6)::INT::DOUBLE), 6) AS night_ratio, round(avg(value), 4) AS mean_value FROM events GROUP BY 1"""
MATCHES = f"""m AS ({METRICS}), t AS (SELECT round(quantile_cont(n_events, 0.9), 6) AS a, round(quantile_cont(night_ratio, 0.75), 6) AS b, round(quantile_cont(mean_value, 0.8), 6) AS c FROM m),
    f AS (SELECT user_id, coalesce(n_events >= a, false) AS match_busy, coalesce(night_ratio >= b, false) AS match_nightly, coalesce(mean_value >= c, false) AS match_costly FROM m, t)"""
POINTS = "SELECT *, 30 + ((user_id * 7919 + event_id * 104729) % 100000) / 1e5::DOUBLE AS lat, 120 + ((user_id * 15485863 + event_id * 32452843) % 100000) / 1e5::DOUBLE AS lon FROM events"
CONDITIONS = {"busy": ("n_events", 0.9), "nightly": ("night_ratio", 0.75), "costly": ("mean_value", 0.8)}


def events(spark, folder):
    return load(spark, folder, "events")


def daily(spark, folder):
    return series.daily(events(spark, folder), "event_type", "ts")


def points(spark, folder):
    """Events with made-up places, as the tables have none."""
    u, e = F.col("user_id"), F.col("event_id")
    return events(spark, folder).select("*", (30 + (u * 7919 + e * 104729) % 100000 / 1e5).alias("lat"), (120 + (u * 15485863 + e * 32452843) % 100000 / 1e5).alias("lon"))


def _matches(spark, folder):
    return filters.condition_matches(relations.subject_metrics(events(spark, folder), "user_id", "event_type", "ts", "value"), "user_id", CONDITIONS)


@query(f"WITH {MATCHES} SELECT *, match_busy::INT + match_nightly::INT + match_costly::INT AS hits FROM f")
def condition_matches(spark, folder):
    return _matches(spark, folder)


@query(f"""WITH {MATCHES} SELECT 1 AS step, 'busy' AS condition, count(*) FILTER (match_busy) AS survivors, count(*) FILTER (match_busy) AS matches FROM f
    UNION ALL SELECT 2, 'nightly', count(*) FILTER (match_busy AND match_nightly), count(*) FILTER (match_nightly) FROM f
    UNION ALL SELECT 3, 'costly', count(*) FILTER (match_busy AND match_nightly AND match_costly), count(*) FILTER (match_costly) FROM f""")
def condition_audit(spark, folder):
    return filters.condition_audit(_matches(spark, folder), list(CONDITIONS))


@query("SELECT ts::DATE AS ds, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(avg((hour(ts) >= 22 OR hour(ts) < 6)::INT::DOUBLE), 6) AS night_ratio FROM events GROUP BY 1")
def daily_activity(spark, folder):
    return trends.daily_activity(events(spark, folder), "user_id", "ts")


@query("SELECT event_type AS category, hour(ts)::INT AS hour, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type))::DOUBLE, 6) AS share FROM events GROUP BY 1, 2")
def hourly_share(spark, folder):
    return trends.hourly_share(events(spark, folder), "event_type", "ts")


@query("""WITH c AS (SELECT event_type AS category, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) AS age FROM events),
    s AS (SELECT category, round(count(*) FILTER (age < 7) / 7.0::DOUBLE, 6) AS recent_mean, round(count(*) FILTER (age >= 7 AND age < 35) / 28.0::DOUBLE, 6) AS baseline_mean FROM c GROUP BY 1)
    SELECT *, round(100 * (recent_mean - baseline_mean) / nullif(baseline_mean, 0), 4) AS change_percent FROM s""")
def recent_against_baseline(spark, folder):
    return trends.recent_against_baseline(events(spark, folder), "event_type", "ts", 7, 28)


@query(f"""WITH {DAILY}, s AS (SELECT unique_id, avg(y) AS m, stddev_pop(y) AS s FROM series GROUP BY 1), z AS (SELECT unique_id, ds, y, CASE WHEN s > 0 THEN round((y - m) / s, 4) ELSE 0 END AS z FROM series JOIN s USING (unique_id))
    SELECT *, CASE WHEN z >= 2 THEN 'spike' WHEN z >= 1 THEN 'mild' WHEN z <= -1 THEN 'drop' ELSE 'usual' END AS tag FROM z""")
def day_scores(spark, folder):
    return trends.day_scores(daily(spark, folder), 2.0, 1.0)


@query(f"""WITH {DAILY}, m AS (SELECT *, median(y) OVER (PARTITION BY unique_id) AS med FROM series), d AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY unique_id) AS mad FROM m)
    SELECT unique_id, ds, y, round(0.6745::DOUBLE * (y - med) / mad, 4) AS score FROM d WHERE mad > 0 AND abs(round(0.6745::DOUBLE * (y - med) / mad, 4)) > 1.5""")
def robust_scores(spark, folder):
    return trends.robust_scores(daily(spark, folder), 1.5)


@query(f"""WITH {DAILY}, p AS (SELECT unique_id, y, ds >= DATE '2024-01-16' AS after FROM series),
    s AS (SELECT unique_id, avg(y) FILTER (NOT after) AS a, avg(y) FILTER (after) AS b, var_samp(y) FILTER (NOT after) AS v0, var_samp(y) FILTER (after) AS v1, count(y) FILTER (NOT after) AS n0, count(y) FILTER (after) AS n1 FROM p GROUP BY 1)
    SELECT unique_id, round(a, 6) AS pre_mean, round(b, 6) AS post_mean, round(b - a, 6) AS change, round((b - a) / nullif(sqrt(v0 / n0 + v1 / n1), 0), 4) AS t,
    round((SELECT avg(b - a) FILTER (unique_id = 'purchase') - avg(b - a) FILTER (unique_id != 'purchase') FROM s), 6) AS effect FROM s""")
def difference_in_differences(spark, folder):
    return trends.difference_in_differences(daily(spark, folder), "purchase", "2024-01-16")


@query(f"""WITH {DAILY}, r AS (SELECT *, y - lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS step, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS r FROM series)
    SELECT unique_id, (max(ds) + 1)::DATE AS ds, round(avg(y) + avg(step) FILTER (r < 5), 6) AS forecast, round(stddev_pop(y), 6) AS band FROM r WHERE r <= 5 GROUP BY 1""")
def trend_forecast(spark, folder):
    return trends.trend_forecast(daily(spark, folder), 5)


@query(f"""WITH {DAILY}, l AS (SELECT unique_id, max(ds) AS last FROM series GROUP BY 1), t AS (SELECT s.unique_id, s.y, b.y AS f FROM series s JOIN l ON s.unique_id = l.unique_id AND date_diff('day', s.ds, l.last) < 14
    JOIN series b ON b.unique_id = s.unique_id AND (b.ds + 7)::DATE = s.ds) SELECT unique_id, round(avg(200.0::DOUBLE * abs(y - f) / nullif(y + f, 0)), 6) AS smape, count(nullif(y + f, 0)) AS n_days FROM t GROUP BY 1""")
def seasonal_backtest(spark, folder):
    return trends.seasonal_backtest(daily(spark, folder), 7, 14)


@query(f"""WITH {DAILY}, x AS (SELECT unique_id, y::DOUBLE AS y, date_diff('day', min(ds) OVER (PARTITION BY unique_id), ds)::DOUBLE AS x FROM series)
    SELECT unique_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS level, round(corr(y, x), 6) AS r FROM x GROUP BY 1""")
def linear_trend(spark, folder):
    return trends.linear_trend(daily(spark, folder))


@query("SELECT event_type, round(entropy(hour(ts)), 6) AS bits FROM events GROUP BY 1")
def hour_entropy(spark, folder):
    return trends.entropy(events(spark, folder).withColumn("_hour", F.hour("ts")), "event_type", "_hour")


@query("""WITH m AS (SELECT event_type AS origin, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS destination FROM events)
    SELECT origin, destination, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY origin))::DOUBLE, 6) AS share FROM m WHERE origin != destination GROUP BY 1, 2""")
def transitions(spark, folder):
    return sequences.transitions(events(spark, folder), *WHO)


@query("""WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), c AS (SELECT user_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c
    FROM b WHERE p IS NULL OR p != event_type WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT user_id, a || '>' || b AS pattern FROM c WHERE b IS NOT NULL UNION ALL SELECT user_id, a || '>' || b || '>' || c FROM c WHERE c IS NOT NULL)
    SELECT pattern, count(DISTINCT user_id) AS support, count(*) AS times FROM g GROUP BY 1""")
def place_ngrams(spark, folder):
    return sequences.ngrams(events(spark, folder), *WHO, 3)


@query("""WITH m AS (SELECT event_type AS origin, (hour(ts) // 6)::INT AS slot, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS destination FROM events),
    s AS (SELECT origin, slot, destination, count(*) AS n FROM m WHERE origin != destination GROUP BY ALL), t AS (SELECT origin, slot, sum(n) AS seen FROM s GROUP BY ALL), g AS (SELECT origin, destination, sum(n) AS n FROM s GROUP BY ALL),
    c AS (SELECT s.* FROM s JOIN t USING (origin, slot) WHERE seen >= 3 UNION ALL SELECT t.origin, t.slot, g.destination, g.n FROM t JOIN g USING (origin) WHERE seen < 3)
    SELECT origin, slot, destination, n::BIGINT AS n, (row_number() OVER (PARTITION BY origin, slot ORDER BY n DESC, destination))::INT AS rank FROM c QUALIFY rank <= 3""")
def next_places(spark, folder):
    return sequences.next_places(events(spark, folder), *WHO, F.floor(F.hour("ts") / 6).cast("int"), 3, 3)


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS started, epoch_us(ts) + (greatest(value, 1) * 60)::BIGINT * 1000000 AS ended FROM events), m AS (SELECT *, max(ended) OVER (PARTITION BY user_id ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM i),
    g AS (SELECT *, sum(CASE WHEN started <= latest THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY started, ended ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(started) AS started, max(ended) AS ended, count(*) AS n_merged FROM g GROUP BY user_id, g""")
def merged_stays(spark, folder):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    stays = events(spark, folder).select("user_id", start.alias("started"), (start + F.rint(F.greatest("value", F.lit(1.0)) * 60).cast("long") * 1000000).alias("ended"))
    return sequences.merged_intervals(stays, "user_id", "started", "ended")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_events(spark, folder):
    return sequences.first_of(events(spark, folder).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query(f"""WITH p AS ({POINTS}), l AS (SELECT user_id, ts, event_id, lat, lon, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    h AS (SELECT *, 12742.0176::DOUBLE * asin(sqrt(pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - o) / 2), 2))) AS km FROM l)
    SELECT user_id, count(*) AS n_points, round(coalesce(sum(km), 0), 4) AS path_km FROM h GROUP BY 1""")
def path_lengths(spark, folder):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = points(spark, folder).select("user_id", geo.haversine_km(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")).alias("km"))
    return steps.groupBy("user_id").agg(F.count("*").alias("n_points"), F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 4).alias("path_km"))


def _letter(first: int) -> str:
    bits = "+".join(f"((({'x' if i % 2 == 0 else 'y'} >> {9 - i // 2}) & 1) << {4 - (i - first)})" for i in range(first, first + 5))
    return f"substr('{geo.BASE32}', (1 + {bits})::INT, 1)"


@query(f"""WITH p AS ({POINTS}), c AS (SELECT user_id, floor((lon + 180) / 360 * 1024)::BIGINT AS x, floor((lat + 90) / 180 * 1024)::BIGINT AS y FROM p)
    SELECT {" || ".join(_letter(i) for i in range(0, 20, 5))} AS cell, count(*) AS n, count(DISTINCT user_id) AS n_users FROM c GROUP BY 1""")
def grid_counts(spark, folder):
    cells = points(spark, folder).select("user_id", geo.geohash(F.col("lat"), F.col("lon"), 4).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def flow_distribution(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, folder).groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH d AS (SELECT event_type AS unique_id, round(epoch_us(ts) / 1e6::DOUBLE - lag(epoch_us(ts) / 1e6::DOUBLE) OVER (PARTITION BY event_type ORDER BY ts), 3) AS seconds FROM events),
    c AS (SELECT unique_id, seconds, count(*) AS n FROM d WHERE seconds > 0 GROUP BY 1, 2) SELECT unique_id, arg_max(seconds, (n, -seconds)) AS seconds, max(n) AS n FROM c GROUP BY 1""")
def frequency(spark, folder):
    return series.spacing(events(spark, folder), "event_type", "ts")


@query(f"WITH {DAILY} SELECT unique_id, count(y) AS n_points, count(y) >= 30 AS sufficient FROM series GROUP BY 1")
def sufficient_series(spark, folder):
    return series.sufficient(daily(spark, folder), 30)


@query("""WITH d AS (SELECT event_id, user_id, md5(props) AS digest, lag(md5(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT event_id, user_id, digest, CASE WHEN b IS NULL THEN 'new' ELSE 'changed' END AS state FROM d WHERE b IS NULL OR b != digest""")
def changed_content(spark, folder):
    return series.changes(events(spark, folder), "user_id", ["ts", "event_id"], "props").select("event_id", "user_id", "digest", "state")

"""The registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mobility, profiling, relations, retrieval, series
from ..sources.tables import load
from . import activity, business, detectors, files, graphs, models, overviews, people, passages, patches, risk, scalars, scenes, searches, streams, trajectories


def _events(spark, folder):
    return load(spark, folder, "events")


def _part_suppliers(spark, folder):
    return load(spark, folder, "lineitem").select("l_suppkey", "l_partkey")


def numeric_profile(spark, folder):
    return profiling.numeric_profile(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


def categorical_profile(spark, folder):
    return profiling.categorical_profile(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


def top_values(spark, folder):
    return profiling.top_values(load(spark, folder, "part"), "p_brand")


def share_within(spark, folder):
    return profiling.share_within(load(spark, folder, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


def origin_destination(spark, folder):
    return mobility.origin_destination(_events(spark, folder), "user_id", "event_type", "ts", "event_id")


def trips(spark, folder):
    return mobility.trips(_events(spark, folder), "user_id", "ts", "event_id", 24)


def heat(spark, folder):
    return mobility.heat(_events(spark, folder), "user_id", "event_type", "ts")


def anonymous_buckets(spark, folder):
    return mobility.anonymous_buckets(_events(spark, folder), "user_id", "event_type", "ts", 3)


def event_impact(spark, folder):
    return mobility.event_impact(_events(spark, folder), "event_type", "ts", "2024-01-10", "2024-01-12", 7)


def contact_pairs(spark, folder):
    return relations.contact_pairs(load(spark, folder, "lineitem").withColumn("other", F.col("l_partkey") % 100 + 1), "l_suppkey", "other")


def shared_partners(spark, folder):
    return relations.shared_partners(_part_suppliers(spark, folder), "l_suppkey", "l_partkey", 3)


def hops(spark, folder):
    edges = _part_suppliers(spark, folder).select(F.col("l_suppkey").alias("s"), (-1 - F.col("l_partkey")).alias("t"))
    both = edges.union(edges.select("t", "s"))
    return relations.hops(both, "s", "t", spark.range(1, 2).select(F.col("id").alias("node")), 3)


def subject_metrics(spark, folder):
    return relations.subject_metrics(_events(spark, folder), "user_id", "event_type", "ts", "value")


def screening_score(spark, folder):
    metrics = relations.subject_metrics(_events(spark, folder), "user_id", "event_type", "ts", "value").select("user_id", "n_events", "night_ratio")
    return relations.screening_score(metrics, {"n_events": 4.0, "night_ratio": 3.0})


def daily_series(spark, folder):
    return series.daily(_events(spark, folder), "event_type", "ts")


def rolling_anomalies(spark, folder):
    return series.rolling_anomalies(series.daily(_events(spark, folder), "event_type", "ts"), 7, 2.0)


def seasonal_forecast(spark, folder):
    return series.seasonal_forecast(series.daily(_events(spark, folder), "event_type", "ts"), 7, 14)


def nearest_centroid(spark, folder):
    return retrieval.nearest_centroid(load(spark, folder, "embeddings"), "vec_id", "embedding", "label")


def rank_fusion(spark, folder):
    customers = load(spark, folder, "customer")
    spent = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return retrieval.fuse([retrieval.ranked(customers, "c_custkey", F.desc("c_acctbal"), 50), retrieval.ranked(spent, "c_custkey", F.desc("spent"), 50)], "c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        origin_destination, numeric_profile, categorical_profile, top_values, share_within, trips, heat, anonymous_buckets, event_impact, contact_pairs,
        shared_partners, hops, subject_metrics, screening_score, daily_series, rolling_anomalies, seasonal_forecast, nearest_centroid, rank_fusion,
    )
}
FAMILIES = (activity, business, scenes, streams, scalars, files, searches, risk, overviews, trajectories, graphs, detectors, patches, passages, models, people)
for _family in FAMILIES:
    QUERIES |= _family.QUERIES

_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c})::DOUBLE AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS most, count(*) FILTER ({c} IS NULL)::DOUBLE AS nulls FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)
_CATEGORIES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, sum(t) FILTER (v IS NOT NULL)::BIGINT AS n, count(v) AS n_distinct, arg_min(v, (-t, v)) FILTER (v IS NOT NULL) AS mode, coalesce(sum(t) FILTER (v IS NULL), 0)::BIGINT AS nulls FROM (SELECT {c} AS v, count(*) AS t FROM orders GROUP BY 1)"
    for c in ("o_orderstatus", "o_orderpriority")
)
_DAILY = """counts AS (SELECT event_type AS unique_id, ts::DATE AS ds, count(*) AS y FROM events GROUP BY 1, 2),
    span AS (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY))::DATE AS ds FROM counts GROUP BY 1),
    series AS (SELECT unique_id, ds, coalesce(y, 0) AS y FROM span LEFT JOIN counts USING (unique_id, ds))"""
_METRICS = """SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_categories, round(avg((hour(ts) >= 22 OR hour(ts) <= 6)::INT::DOUBLE), 6) AS night_ratio,
    round(avg(value), 4) AS mean_value, round(count(DISTINCT ts::DATE) / (date_diff('day', min(ts::DATE), max(ts::DATE)) + 1)::DOUBLE, 6) AS active_ratio FROM events GROUP BY 1"""
_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"

ORACLE_SQL = {
    "origin_destination": """SELECT event_type AS origin, destination, count(*) AS flow, count(DISTINCT user_id) AS n_users, round(avg((epoch_us(next_ts) - epoch_us(ts)) / 3.6e9), 4) AS mean_hours
        FROM (SELECT *, lead(event_type) OVER w AS destination, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE destination != event_type GROUP BY 1, 2""",
    "numeric_profile": _PROFILE,
    "categorical_profile": _CATEGORIES,
    "top_values": "SELECT p_brand AS value, count(*) AS times, round(100.0 * count(*) / (SELECT count(p_brand) FROM part)::DOUBLE, 2) AS percent FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "share_within": "SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS n_keys, round(count(DISTINCT c_custkey) / (sum(count(DISTINCT c_custkey)) OVER (PARTITION BY c_nationkey))::DOUBLE, 6) AS share FROM customer GROUP BY 1, 2",
    "trips": """SELECT user_id, trip::BIGINT AS trip, min(ts) AS started, max(ts) AS ended, count(*) AS n_points FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS trip FROM
        (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 24 * 3.6e9, true)::INT AS b FROM events)) GROUP BY 1, 2""",
    "heat": """WITH h AS (SELECT ts::DATE AS day, hour(ts)::INT AS hour, user_id, event_type FROM events), c AS (SELECT day, hour, event_type, count(*) AS n FROM h GROUP BY 1, 2, 3),
        t AS (SELECT day, hour, sum(n)::BIGINT AS n_rows, array_to_string(list_slice(list(event_type ORDER BY n DESC, event_type), 1, 5), ',') AS top_categories FROM c GROUP BY 1, 2)
        SELECT day, hour, n_users, n_rows, top_categories FROM (SELECT day, hour, count(DISTINCT user_id) AS n_users FROM h GROUP BY 1, 2) JOIN t USING (day, hour)""",
    "anonymous_buckets": "SELECT ts::DATE AS day, event_type AS category, count(DISTINCT user_id) AS n_users, count(*) AS n_rows FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3",
    "event_impact": """SELECT event_type AS category, count(*) FILTER (d >= DATE '2024-01-03' AND d < DATE '2024-01-10') AS n_before, count(*) FILTER (d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS n_during,
        count(*) FILTER (d > DATE '2024-01-12' AND d <= DATE '2024-01-19') AS n_after, round((n_during / 3.0::DOUBLE) / nullif(n_before / 7.0::DOUBLE, 0), 6) AS ratio FROM (SELECT event_type, ts::DATE AS d FROM events) GROUP BY 1""",
    "contact_pairs": "SELECT least(l_suppkey, o) AS a, greatest(l_suppkey, o) AS b, count(*) AS contacts FROM (SELECT l_suppkey, l_partkey % 100 + 1 AS o FROM lineitem) WHERE l_suppkey != o GROUP BY 1, 2",
    "shared_partners": "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 3",
    "hops": """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, -1 - l_partkey AS t FROM lineitem UNION SELECT DISTINCT -1 - l_partkey, l_suppkey FROM lineitem),
        r(node, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT e.t, r.hop + 1 FROM r JOIN e ON e.s = r.node WHERE r.hop < 3) SELECT node, min(hop)::INT AS hop FROM r GROUP BY 1""",
    "subject_metrics": _METRICS,
    "screening_score": f"WITH m AS ({_METRICS}) SELECT user_id, n_events, night_ratio, round((4.0 * {_RANK.format('n_events')} + 3.0 * {_RANK.format('night_ratio')}) / count(*) OVER ()::DOUBLE, 4) AS screening_score FROM m",
    "daily_series": f"WITH {_DAILY} SELECT * FROM series",
    "rolling_anomalies": f"""WITH {_DAILY} SELECT unique_id, ds, y, round((y - m) / s, 4) AS score FROM (SELECT *, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s, count(*) OVER w AS n FROM series
        WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE n = 7 AND s > 0 AND abs(round((y - m) / s, 4)) > 2.0""",
    "seasonal_forecast": f"""WITH {_DAILY}, l AS (SELECT unique_id, max(ds) AS last FROM series GROUP BY 1) SELECT unique_id, (last + step::INT)::DATE AS ds, y AS forecast FROM series JOIN l USING (unique_id), range(1, 15) r(step)
        WHERE date_diff('day', ds, last) < 7 AND date_diff('day', ds, (last + step::INT)::DATE) % 7 = 0""",
    "nearest_centroid": """WITH p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2), m AS (SELECT label AS nearest, list(x ORDER BY i) AS mean FROM p GROUP BY 1),
        s AS (SELECT vec_id, label, nearest, round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) AS similarity FROM embeddings, m) SELECT vec_id, label, arg_max(nearest, (similarity, -nearest)) AS nearest, max(similarity) AS similarity FROM s GROUP BY 1, 2""",
    "rank_fusion": """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer), b AS (SELECT o_custkey AS c_custkey, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS r FROM orders GROUP BY 1)
        SELECT c_custkey, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50) GROUP BY 1""",
}
for _family in FAMILIES:
    ORACLE_SQL |= _family.ORACLE_SQL

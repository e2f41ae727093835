"""Queries of single expressions: texts, times, places, JSON, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, geo, text
from ..sources.tables import load
from .activity import POINTS, events, points
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
PARTS = r"'[ \t\n\r,，。、:：]+'"
TOKENS = r"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[一-鿿]{{2,}}|[A-Za-z0-9]+(?:[.][0-9]+)?'), lambda t: lower(t)), lambda t: len(t) >= 2))"
ASKED = "the state of a market, item 25% and 3 of 7"
NORMAL = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{text.DROPPED}', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '(?i)https?://[^ \\t\\n\\r]*utm_[^ \\t\\n\\r]*', '', 'g'), '\\b[0-9]{{10,13}}\\b', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"""
RING = [[120.2, 30.2], [120.9, 30.3], [120.7, 30.9], [120.4, 30.6]]
BOX = "[(user_id % 7)::DOUBLE, (user_id % 5)::DOUBLE, (user_id % 7 + event_id % 4)::DOUBLE, (user_id % 5 + event_id % 3)::DOUBLE]"


@query("SELECT p_partkey, left(p_name, 12) || '...' AS preview FROM part")
def previews(spark, folder):
    return load(spark, folder, "part").select("p_partkey", text.preview(F.col("p_name")).alias("preview"))


@query(f"""WITH t AS (SELECT doc_id, text, regexp_split_to_array(lower(text), {PARTS}) AS t FROM documents), q AS (SELECT list_filter(regexp_split_to_array(lower('{ASKED}'), {PARTS}), lambda x: x != '') AS q)
    SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(list_filter(t, lambda x: list_contains(q, x))) / sqrt(len(t)) END, 6) AS score FROM t, q""")
def query_scores(spark, folder):
    return load(spark, folder, "documents").select("doc_id", F.round(text.query_score(ASKED, F.col("text")), 6).alias("score"))


@query(f"""WITH t AS (SELECT item_id, {TOKENS.format('text')} AS a, {TOKENS.format("'" + ASKED + "'")} AS b FROM benchmark)
    SELECT item_id, len(a) AS n_tokens, round(coalesce(len(list_intersect(a, b)) / nullif(sqrt(len(a) * len(b)), 0), 0), 6) AS overlap FROM t""")
def token_overlaps(spark, folder):
    own = load(spark, folder, "benchmark").select("item_id", text.tokens(F.col("text")).alias("a"), text.tokens(F.lit(ASKED)).alias("b"))
    return own.select("item_id", F.size("a").cast("long").alias("n_tokens"), F.round(text.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("""SELECT doc_id, round((contains(replace(coalesce(text, ''), ' ', ''), '25%')::INT + contains(replace(coalesce(text, ''), ' ', ''), '3')::INT + contains(replace(coalesce(text, ''), ' ', ''), '7')::INT) / 3.0::DOUBLE, 6) AS share FROM documents""")
def numeric_mentions(spark, folder):
    return load(spark, folder, "documents").select("doc_id", F.round(text.numeric_mentions(ASKED, F.col("text")), 6).alias("share"))


@query("SELECT conv_id, turn, 'chunk-' || sha256(concat_ws(chr(31), 'talks', 'v1', conv_id::VARCHAR, turn::VARCHAR, md5(text))) AS chunk_id FROM conversations")
def chunk_ids(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", "turn", text.chunk_id(F.lit("talks"), F.lit("v1"), F.col("conv_id"), F.col("turn"), F.md5("text")).alias("chunk_id"))


@query(f"SELECT page_id, sha256(url || chr(10) || html) AS raw_hash, sha256({NORMAL}) AS normal_hash FROM pages")
def page_hashes(spark, folder):
    html = F.col("html")
    return load(spark, folder, "pages").select("page_id", F.sha2(F.concat("url", F.lit("\n"), html), 256).alias("raw_hash"), F.sha2(text.normal_text(html), 256).alias("normal_hash"))


@query("""SELECT hour(ts)::INT AS hour, CASE WHEN hour(ts) >= 23 OR hour(ts) < 7 THEN '凌晨' WHEN hour(ts) < 9 THEN '早高峰' WHEN hour(ts) < 11 THEN '上午' WHEN hour(ts) < 13 THEN '午间' WHEN hour(ts) < 17 THEN '下午'
    WHEN hour(ts) < 19 THEN '晚高峰' ELSE '夜间' END AS slot, count(*) AS n FROM events GROUP BY 1, 2""")
def day_slots(spark, folder):
    hour = F.hour("ts")
    return events(spark, folder).groupBy(hour.alias("hour"), calendar.day_slot(hour).alias("slot")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, coalesce(strftime(ts, '%Y-%m-%dT%H:00:00'), 'unknown') AS by_hour, coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS by_day, coalesce(strftime(ts, '%Y-%m'), 'unknown') AS by_month,
    CASE WHEN ts IS NULL THEN 'unknown' ELSE 'all' END AS by_all FROM events""")
def time_buckets(spark, folder):
    return events(spark, folder).select("event_id", *(calendar.bucket(F.col("ts"), w).alias(f"by_{w}") for w in ("hour", "day", "month", "all")))


@query("""SELECT o_orderkey, (o_orderdate::DATE + to_months(o_orderkey % 14))::TIMESTAMP AS next_month, o_orderdate + to_hours(o_orderkey % 50) AS next_hour, o_orderdate + to_days((o_orderkey % 9)::INT) AS next_day FROM orders""")
def calendar_steps(spark, folder):
    key = F.col("o_orderkey")
    made = [calendar.advance(F.col("o_orderdate"), u, (key % n).cast("int")).cast("timestamp_ntz").alias(f"next_{u}") for u, n in (("month", 14), ("hour", 50), ("day", 9))]
    return load(spark, folder, "orders").select("o_orderkey", *made)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN hour(ts) WHEN event_id % 30 < 24 THEN event_id % 30 END::INT AS hour FROM events")
def hour_fallback(spark, folder):
    """Times as text, of which only every third can be read; the others have an hour beside them, out of range now and then."""
    made = events(spark, folder).select("event_id", F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("n/a").alias("t"), (F.col("event_id") % 30).cast("string").alias("h"))
    return made.select("event_id", calendar.hour_of(F.col("t"), F.col("h")).alias("hour"))


@query("""WITH u AS (SELECT event_id, value, (event_id * 7919 % 99991 + 0.5::DOUBLE) / 99991 - 0.5 AS u FROM events) SELECT event_id, round(value - 2.0 * sign(u) * ln(1 - 2 * abs(u)), 6) AS noisy FROM u""")
def laplace_noise(spark, folder):
    """Noise of scale 2 by the inverse of its distribution, from a uniform column that a rerun gives again."""
    u = (F.col("event_id") * 7919 % 99991 + 0.5) / 99991 - 0.5
    return events(spark, folder).select("event_id", F.round(F.col("value") - 2.0 * F.signum(u) * F.log(1 - 2 * F.abs(u)), 6).alias("noisy"))


@query("""WITH s AS (SELECT user_id, list(DISTINCT event_type) AS own FROM events GROUP BY 1) SELECT user_id, round(len(list_intersect(own, ['click', 'view', 'refund'])) / len(list_distinct(list_concat(own, ['click', 'view', 'refund'])))::DOUBLE, 6) AS jaccard,
    round(len(list_intersect(own, ['click', 'view', 'refund'])) / len(own)::DOUBLE, 6) AS overlap FROM s""")
def set_overlaps(spark, folder):
    asked = F.array(*map(F.lit, ("click", "view", "refund")))
    own = events(spark, folder).groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    both = F.size(F.array_intersect("own", asked))
    return own.select("user_id", F.round(F.coalesce(F.try_divide(both, F.size(F.array_union("own", asked))), F.lit(0.0)), 6).alias("jaccard"), F.round(F.coalesce(F.try_divide(both, F.size("own")), F.lit(0.0)), 6).alias("overlap"))


@query(f"""WITH p AS ({POINTS}), e AS (SELECT event_id, lon AS x, lat AS y, unnest([[120.2, 30.2, 120.4, 30.6], [120.9, 30.3, 120.2, 30.2], [120.7, 30.9, 120.9, 30.3], [120.4, 30.6, 120.7, 30.9]]::DOUBLE[][]) AS e FROM p)
    SELECT event_id, count(*) FILTER ((e[2] > y) != (e[4] > y) AND x < (e[3] - e[1]) * (y - e[2]) / (e[4] - e[2]) + e[1]) % 2 = 1 AS inside FROM e GROUP BY 1""")
def points_in_polygon(spark, folder):
    ring = F.array(*(F.array(*map(F.lit, p)) for p in RING))
    return points(spark, folder).select("event_id", geo.in_polygon(F.col("lon"), F.col("lat"), ring).alias("inside"))


@query("SELECT user_id, round(abs(3.0 * a + 0.0) , 6) AS area, [0.0, 0.0, a, 3.0]::DOUBLE[] AS bounds FROM (SELECT DISTINCT user_id, (user_id % 9 + 1)::DOUBLE AS a FROM events)")
def polygon_measures(spark, folder):
    """Area and bounds of rectangles, one per user."""
    a, zero, three = (F.col("user_id") % 9 + 1).cast("double"), F.lit(0.0), F.lit(3.0)
    ring = F.array(F.array(zero, zero), F.array(a, zero), F.array(a, three), F.array(zero, three))
    return events(spark, folder).select("user_id").distinct().select("user_id", F.round(geo.polygon_area(ring), 6).alias("area"), geo.polygon_bounds(ring).alias("bounds"))


@query(f"""WITH b AS (SELECT event_id, {BOX} AS a, [1.0, 1.0, 6.0, 4.0]::DOUBLE[] AS b FROM events), m AS (SELECT event_id, a, greatest(0, a[3] - a[1]) * greatest(0, a[4] - a[2]) AS area,
    greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) AS shared FROM b)
    SELECT event_id, area, (a[1] + a[3]) / 2 AS x, (a[2] + a[4]) / 2 AS y, CASE WHEN area > 0 THEN round(shared / area, 6) ELSE 0 END AS overlap FROM m""")
def box_measures(spark, folder):
    u, e = F.col("user_id"), F.col("event_id")
    own = F.array(*(c.cast("double") for c in (u % 7, u % 5, u % 7 + e % 4, u % 5 + e % 3)))
    made = events(spark, folder).select("event_id", own.alias("a"))
    a, b = F.col("a"), F.array(*map(F.lit, (1.0, 1.0, 6.0, 4.0)))
    return made.select("event_id", geo.box_area(a).alias("area"), ((a[0] + a[2]) / 2).alias("x"), ((a[1] + a[3]) / 2).alias("y"), F.round(geo.box_overlap(a, b), 6).alias("overlap"))


@query(f"""SELECT event_id, round(-90 + 180 * (floor((lat + 90) / 180 * 1024) + 0.5) / 1024, 8) AS cell_lat, round(-180 + 360 * (floor((lon + 180) / 360 * 1024) + 0.5) / 1024, 8) AS cell_lon FROM ({POINTS})""")
def cell_centres(spark, folder):
    """The middle of each point's cell of four letters, by way of its geohash."""
    cells = points(spark, folder).select("event_id", geo.geohash(F.col("lat"), F.col("lon"), 4).alias("cell"))
    lat, lon = geo.geohash_centre(F.col("cell"), 4)
    return cells.select("event_id", F.round(lat, 8).alias("cell_lat"), F.round(lon, 8).alias("cell_lon"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.\"k\"')) AS k, NULL::VARCHAR AS gone, 'x' || event_id AS deep, 'y' AS flat FROM events")
def nested_values(spark, folder):
    made = F.concat(F.lit('{"a": {"b": "x'), F.col("event_id"), F.lit('"}, "c.d": "y"}'))
    values = {"k": text.nested(F.col("props"), "k"), "gone": text.nested(F.col("props"), "no.where"), "deep": text.nested(made, "a.b"), "flat": text.nested(made, "c.d")}
    return events(spark, folder).select("event_id", *(c.alias(n) for n, c in values.items()))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|copper') THEN 'metal' WHEN regexp_matches(lower(p_type), 'promo|econ') THEN 'offer' ELSE 'other' END AS class FROM part""")
def keyword_classes(spark, folder):
    return load(spark, folder, "part").select("p_partkey", text.keyword_class(F.col("p_type"), {"metal": ["steel", "copper"], "offer": ["promo", "econ"]}, "other").alias("class"))


@query("""SELECT event_id, try_cast(a AS INT) AS whole, try_cast(a AS DOUBLE) AS real, try_cast(b AS TIMESTAMP) AS at FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE event_id::VARCHAR END AS a,
    CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS b FROM events)""")
def safe_casts(spark, folder):
    e = F.col("event_id")
    made = events(spark, folder).select("event_id", F.when(e % 4 == 0, "none").otherwise(e.cast("string")).alias("a"), F.when(e % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("b"))
    return made.select("event_id", F.col("a").try_cast("int").alias("whole"), F.col("a").try_cast("double").alias("real"), F.col("b").try_cast("timestamp_ntz").alias("at"))


@query("SELECT c_custkey, coalesce(c_acctbal < 0, false) OR lower(coalesce(c_mktsegment, '')) IN ('machinery') AS risk_flag FROM customer")
def risk_flags(spark, folder):
    """A risk if the label says so or the lower label is one of the listed; null counts as neither."""
    labelled = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    return load(spark, folder, "customer").select("c_custkey", (labelled | F.lower(F.coalesce("c_mktsegment", F.lit(""))).isin("machinery")).alias("risk_flag"))


@query("SELECT user_id, round(greatest(0, least(1, 0.3 * ln(1 + sum(value)) / ln(1000) + 0.05 * ln(1 + count(*)))), 6) AS score FROM events GROUP BY 1")
def log_scores(spark, folder):
    """A score of logarithms, held between 0 and 1."""
    score = 0.3 * F.log1p(F.sum("value")) / F.log(F.lit(1000.0)) + 0.05 * F.log1p(F.count("*"))
    return events(spark, folder).groupBy("user_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"))

"""Queries that search and filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import filters, search
from ..sources.tables import load
from .activity import POINTS, events, points
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
BOX = (120.1, 30.1, 120.8, 30.9)
FLAGS = "SELECT c_custkey, coalesce(c_acctbal > 1000, false) AS match_rich, coalesce(c_mktsegment = 'BUILDING', false) AS match_segment, coalesce(c_nationkey IN (1, 2, 3, 4, 5), false) AS match_near FROM customer"
SUBJECTS = "SELECT user_id, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1"


def _asked():
    return {"rich": F.col("c_acctbal") > 1000, "segment": F.col("c_mktsegment") == "BUILDING", "near": F.col("c_nationkey").isin(1, 2, 3, 4, 5)}


def _sparse(spark, folder):
    """Points of which some lack their time or place."""
    e = F.col("event_id")
    return points(spark, folder).withColumns({"ts": F.when(e % 11 != 0, F.col("ts")), "lat": F.when(e % 7 != 0, F.col("lat"))})


SPARSE = f"SELECT * REPLACE (CASE WHEN event_id % 11 != 0 THEN ts END AS ts, CASE WHEN event_id % 7 != 0 THEN lat END AS lat) FROM ({POINTS})"


@query(f"""SELECT event_id, user_id FROM ({SPARSE}) WHERE event_type LIKE '%c%' AND event_type LIKE '%li%' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25' AND (hour(ts) >= 20 OR hour(ts) < 9)
    AND lat BETWEEN 30.1 AND 30.9 AND lon BETWEEN 120.1 AND 120.8""")
def spatiotemporal_search(spark, folder):
    found = search.spatiotemporal(_sparse(spark, folder), "ts", "lat", "lon", words="C li", start="2024-01-03", end="2024-01-25", hours=(20, 9), box=BOX, text_columns=["event_type"])
    return found.select("event_id", "user_id")


@query(f"SELECT event_id FROM ({POINTS}) WHERE floor((lon + 180) / 360 * 256) = 213 AND floor((lat + 90) / 180 * 128) = 85 ORDER BY ts, event_id LIMIT 20")
def first_found(spark, folder):
    """The first rows by time of a cell of three letters: one of 256 by 128 parts of the earth."""
    cells = points(spark, folder).withColumn("cell", geo.geohash(F.col("lat"), F.col("lon"), 6))
    return search.first_rows(search.spatiotemporal(cells, "ts", "lat", "lon", cell="cell", prefix="wtm"), ["ts", "event_id"], 20).select("event_id")


@query(f"""SELECT event_id, round(1.0 / (1 + abs(value - 50)), 6) AS score FROM ({SPARSE}) WHERE (ts IS NULL OR (ts >= TIMESTAMP '2024-01-05' AND (hour(ts) >= 8 AND hour(ts) < 20)))
    AND (lat IS NULL OR (lat BETWEEN 30.1 AND 30.9 AND lon BETWEEN 120.1 AND 120.8)) ORDER BY score DESC, event_id LIMIT 20""")
def scored_search(spark, folder):
    score = 1.0 / (1 + F.abs(F.col("value") - 50))
    return search.scored(_sparse(spark, folder), score, "event_id", "ts", "lat", "lon", start="2024-01-05", hours=(8, 20), box=BOX).select("event_id", "score")


@query(f"""SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12') AS in_window, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS at_night, count(*) FILTER (lat BETWEEN 30.1 AND 30.9 AND lon BETWEEN 120.1 AND 120.8) AS in_box FROM ({SPARSE})""")
def window_predicates(spark, folder):
    ts = F.col("ts")
    return _sparse(spark, folder).agg(
        F.count_if(search.in_time(ts, "2024-01-10", "2024-01-12")).alias("in_window"), F.count_if(search.in_time(ts, hours=(22, 6))).alias("at_night"), F.count_if(geo.in_box(F.col("lat"), F.col("lon"), BOX)).alias("in_box")
    )


@query(f"""SELECT event_id, round(d, 6) AS distance_km FROM (SELECT event_id, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(30.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30.5)) * pow(sin(radians(120.5 - lon) / 2), 2))) AS d FROM ({POINTS})) WHERE d <= 25""")
def radius_filter(spark, folder):
    return search.within_distance(points(spark, folder), "lat", "lon", (30.5, 120.5), 25.0).select("event_id", "distance_km")


@query(f"SELECT *, h AS hits, h = 3 AS all_match, h > 0 AS any_match FROM (SELECT *, match_rich::INT + match_segment::INT + match_near::INT AS h FROM ({FLAGS})) ".replace("SELECT *, h AS", "SELECT * EXCLUDE (h), h AS"))
def condition_masks(spark, folder):
    return search.conditions(load(spark, folder, "customer"), "c_custkey", _asked())


@query(f"""WITH f AS ({FLAGS}) SELECT 'all' AS mode, 1 AS step, 'rich' AS condition, count(*) FILTER (match_rich) AS survivors FROM f UNION ALL SELECT 'all', 2, 'segment', count(*) FILTER (match_rich AND match_segment) FROM f
    UNION ALL SELECT 'all', 3, 'near', count(*) FILTER (match_rich AND match_segment AND match_near) FROM f UNION ALL SELECT 'any', 1, 'rich', count(*) FILTER (match_rich) FROM f UNION ALL SELECT 'any', 2, 'segment', count(*) FILTER (match_segment) FROM f
    UNION ALL SELECT 'any', 3, 'near', count(*) FILTER (match_near) FROM f UNION ALL SELECT 'any', 4, 'any', count(*) FILTER (match_rich OR match_segment OR match_near) FROM f""")
def mask_audit(spark, folder):
    matches = search.conditions(load(spark, folder, "customer"), "c_custkey", _asked())
    all_, any_ = (search.audit(matches, list(_asked()), m).select(F.lit(m).alias("mode"), "*") for m in ("all", "any"))
    return all_.union(any_)


@query(f"WITH s AS ({SUBJECTS}) SELECT 'n_events' AS measure, greatest(10.0::DOUBLE, ceil(quantile_cont(n_events, 0.9))) AS threshold FROM s UNION ALL SELECT 'total', greatest(1e9::DOUBLE, ceil(quantile_cont(total, 0.75))) FROM s")
def automatic_thresholds(spark, folder):
    own = events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    a, b = search.upper_threshold(own, "n_events", 0.9, 10.0), search.upper_threshold(own, "total", 0.75, 1e9)
    return a.select(F.lit("n_events").alias("measure"), "threshold").union(b.select(F.lit("total"), "threshold"))


@query("SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 10 AND p_size != 20 AND p_name LIKE '%a%' AND p_brand LIKE 'B%' AND p_size IN (10, 12, 15, 20, 25, 30, 40) ORDER BY p_size DESC, p_partkey LIMIT 25")
def ordered_property_filter(spark, folder):
    asked = [("p_size", ">=", 10), ("p_size", "!=", 20), ("p_name", "CONTAINS", "a"), ("p_brand", "STARTS WITH", "B"), ("p_size", "IN", [10, 12, 15, 20, 25, 30, 40])]
    return filters.property_filter(load(spark, folder, "part"), asked).orderBy(F.desc("p_size"), "p_partkey").limit(25).select("p_partkey", "p_size", "p_brand")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND o_totalprice > 1000 AND o_orderstatus = 'O'")
def free_filter(spark, folder):
    """Conditions as text on the start node and on the relation."""
    start = load(spark, folder, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return start.join(load(spark, folder, "orders").where("o_totalprice > 1000 AND o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT * FROM supplier WHERE s_suppkey = 7 OR s_name = (SELECT min(s_name) FROM supplier)")
def node_lookup(spark, folder):
    """A node by its key, and one by its name; the condition reaches the scan."""
    suppliers = load(spark, folder, "supplier")
    return suppliers.where("s_suppkey = 7").unionByName(suppliers.join(suppliers.agg(F.min("s_name").alias("s_name")), "s_name", "left_semi")).distinct()


@query("""SELECT o_orderkey, score FROM (SELECT *, round(CASE WHEN contains(lower(o_orderpriority), 'high') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 5.0 ELSE 0.0 END, 4)::DOUBLE AS score FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2030-01-01' AND o_orderstatus = 'O') WHERE score > 0 ORDER BY score DESC, o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 10""")
def faceted_search(spark, folder):
    return search.faceted(load(spark, folder, "orders"), "HIGH urgent", {"o_orderpriority": 5.0}, {"o_orderstatus": "O"}, ("o_orderdate", "1995-01-01", "2030-01-01"), "o_orderdate", "o_orderkey", 2, 10).select("o_orderkey", "score")


@query("SELECT page_id, (SELECT count(*) FROM pages WHERE contains(lower(url), 'a') OR contains(lower(html), 'the')) AS total FROM pages WHERE contains(lower(url), 'a') OR contains(lower(html), 'the') ORDER BY page_id LIMIT 10 OFFSET 10")
def record_search(spark, folder):
    found = search.like_any(load(spark, folder, "pages"), "A", ["url"]).select("page_id").union(search.like_any(load(spark, folder, "pages"), "The", ["html"]).select("page_id")).distinct()
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("page_id").offset(10).limit(10).crossJoin(F.broadcast(total))


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ready' ELSE 'failed' END AS status, doc_id % 2 = 0 AS is_current, CASE WHEN doc_id % 5 > 0 THEN 'w' || doc_id % 5 END AS workspace FROM documents) WHERE status = 'ready' AND is_current AND (workspace IS NULL OR workspace = 'w2')")
def visible_documents(spark, folder):
    d = F.col("doc_id")
    made = load(spark, folder, "documents").select("doc_id", F.when(d % 3 == 0, "ready").otherwise("failed").alias("status"), (d % 2 == 0).alias("is_current"), F.when(d % 5 > 0, F.concat(F.lit("w"), d % 5)).alias("workspace"))
    return search.visible(made, "w2").select("doc_id")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS VARCHAR), event_type) AS kind, user_id AS who FROM events")
def aliased_fields(spark, folder):
    from ..sources.files import canonical

    made = events(spark, folder).select("*", text.nested(F.col("props"), "k").alias("k"))
    return canonical(made, {"event_id": [], "kind": ["k", "event_type"], "who": ["actor", "user_id"]})


@query(f"""WITH p AS (SELECT event_id, 'c' || user_id % 3 AS city, 'w' || (event_id % 50) AS cell FROM events), l AS (SELECT city, cell, min('L' || event_id) AS landmark FROM p WHERE event_id % 2 = 0 GROUP BY 1, 2),
    n AS (SELECT city, left(cell, 2) AS pre, min(landmark) AS near FROM l GROUP BY 1, 2) SELECT event_id, p.city, p.cell, coalesce(landmark, near) AS landmark FROM p LEFT JOIN l ON l.city = p.city AND l.cell = p.cell LEFT JOIN n ON n.city = p.city AND n.pre = left(p.cell, 2)""")
def landmarks(spark, folder):
    rows = events(spark, folder).select("event_id", F.concat(F.lit("c"), F.col("user_id") % 3).alias("city"), F.concat(F.lit("w"), F.col("event_id") % 50).alias("cell"))
    gazetteer = rows.where("event_id % 2 = 0").groupBy("city", "cell").agg(F.min(F.concat(F.lit("L"), "event_id")).alias("landmark"))
    return search.with_landmarks(rows, gazetteer, "city", "cell", 2).select("event_id", "city", "cell", "landmark")


@query("SELECT vec_id, label FROM embeddings")
def compact_samples(spark, folder):
    return search.compact(load(spark, folder, "embeddings"), ["embedding"])


@query("SELECT 'a.b' AS column_name, 'bigint' AS type UNION ALL SELECT 'a.c.d', 'string' UNION ALL SELECT 'e', 'int'")
def flattened_mapping(spark, folder):
    """Names and types of nested properties, from the schema alone."""
    from ..sources.files import flattened

    nested = load(spark, folder, "nation").select(F.struct(F.col("n_nationkey").cast("long").alias("b"), F.struct(F.col("n_name").alias("d")).alias("c")).alias("a"), F.col("n_regionkey").alias("e"))
    return spark.createDataFrame(flattened(nested).dtypes, "column_name string, type string")

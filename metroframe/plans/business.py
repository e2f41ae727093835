"""Queries over customers, suppliers, orders and their lines, taken as subjects, counterparties and contacts; and over pages, vectors and dialogues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, graph, retrieval
from ..sources.tables import load
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 1000 AND contains(c_name, '7')")
def property_filter(spark, folder):
    found = filters.property_filter(load(spark, folder, "customer"), [("c_mktsegment", "IN", ["BUILDING", "MACHINERY"]), ("c_acctbal", ">", 1000), ("c_name", "CONTAINS", "7")])
    return found.select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_acctbal > 0 GROUP BY 1")
def relationship_filter(spark, folder):
    edges = load(spark, folder, "orders").where("o_totalprice > 1000").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return edges.join(load(spark, folder, "customer").where("c_acctbal > 0"), "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def profile_enrich(spark, folder):
    nation, region = load(spark, folder, "nation"), load(spark, folder, "region")
    named = load(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def urgent_customers(spark, folder):
    urgent = load(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return load(spark, folder, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT 'orders.o_custkey' AS link, count(*) AS missing FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
    UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
    UNION ALL SELECT 'lineitem.l_suppkey', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)""")
def reference_gaps(spark, folder):
    found = None
    for table, key, other, to in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")):
        gaps = load(spark, folder, table).join(load(spark, folder, other), F.col(key) == F.col(to), "left_anti").agg(F.lit(f"{table}.{key}").alias("link"), F.count("*").alias("missing"))
        found = gaps if found is None else found.unionByName(gaps)
    return found


@query("""SELECT nationkey, sum(c)::BIGINT AS n_customers, sum(s)::BIGINT AS n_suppliers FROM (SELECT c_nationkey AS nationkey, 1 AS c, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 0, 1 FROM supplier) GROUP BY 1""")
def evidence_merge(spark, folder):
    """A full outer join of counts as one union and one grouping: one shuffle instead of three."""
    customers = load(spark, folder, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit(1).alias("c"), F.lit(0).alias("s"))
    suppliers = load(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit(0).alias("c"), F.lit(1).alias("s"))
    return customers.union(suppliers).groupBy("nationkey").agg(F.sum("c").alias("n_customers"), F.sum("s").alias("n_suppliers"))


@query("""SELECT least(a.n_regionkey, b.n_regionkey) AS region_a, greatest(a.n_regionkey, b.n_regionkey) AS region_b, count(*) AS n_links FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_regionkey != b.n_regionkey GROUP BY 1, 2""")
def cross_region_links(spark, folder):
    nation = load(spark, folder, "nation")
    links = load(spark, folder, "lineitem").join(load(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    buyers = load(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("a"))
    sellers = load(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("b"))
    both = links.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).where("a != b")
    return both.groupBy(F.least("a", "b").alias("region_a"), F.greatest("a", "b").alias("region_b")).agg(F.count("*").alias("n_links"))


@query("""SELECT count(*) AS n_contacts, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT l_partkey) AS n_targets, min(l_shipdate)::DATE AS first_day, max(l_shipdate)::DATE AS last_day,
    round(count(DISTINCT l_shipdate::DATE) / (date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) + 1)::DOUBLE, 6) AS active_ratio, round(avg((dayofweek(l_shipdate) IN (0, 6))::INT::DOUBLE), 6) AS weekend_ratio FROM lineitem""")
def contact_overview(spark, folder):
    day = F.to_date("l_shipdate")
    return load(spark, folder, "lineitem").agg(
        F.count("*").alias("n_contacts"), F.count_distinct("l_suppkey").alias("n_sources"), F.count_distinct("l_partkey").alias("n_targets"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.round(F.count_distinct(day) / (F.date_diff(F.max(day), F.min(day)) + 1), 6).alias("active_ratio"), F.round(F.avg(F.dayofweek("l_shipdate").isin(1, 7).cast("double")), 6).alias("weekend_ratio"),
    )


@query("WITH k AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) SELECT count(*) AS n_items, count(*) FILTER (k >= 2) AS at_least_2, count(*) FILTER (k >= 5) AS at_least_5, count(*) FILTER (k >= 10) AS at_least_10, max(k) AS most FROM k")
def item_sharing(spark, folder):
    return graph.item_sharing(load(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), k AS (SELECT l_partkey, count(*) AS k FROM e GROUP BY 1)
    SELECT l_suppkey, count(*) AS n_items, count(*) FILTER (k >= 2) AS n_shared, sum(k - 1)::BIGINT AS n_peers FROM e JOIN k USING (l_partkey) GROUP BY 1""")
def partner_metrics(spark, folder):
    return graph.partner_metrics(load(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT o_custkey, arg_min(l_suppkey, (-n, l_suppkey)) AS partner, max(n) AS times FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def strongest_partner(spark, folder):
    edges = load(spark, folder, "lineitem").join(load(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.strongest_partner(edges, "o_custkey", "l_suppkey")


@query("WITH e AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT AS n_edges, sum(m)::BIGINT AS n_unique, sum(m * (m - 1) // 2)::BIGINT AS n_incident_pairs FROM e")
def edge_counts(spark, folder):
    return graph.edge_counts(load(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, -1 - l_partkey AS t FROM lineitem), d AS (SELECT s AS node, t AS other FROM e UNION SELECT t, s FROM e), c AS (SELECT node, count(*) AS degree FROM d GROUP BY 1)
    SELECT node, degree, round(degree / nullif((SELECT count(*) FROM c) - 1, 0)::DOUBLE, 6) AS centrality FROM c""")
def degree_centrality(spark, folder):
    return graph.degree_centrality(load(spark, folder, "lineitem").select("l_suppkey", (-1 - F.col("l_partkey")).alias("part")), "l_suppkey", "part")


@query("""SELECT r_name, count(*) AS n_customers, count(*) FILTER (c_acctbal < 0) AS n_risky, round(count(*) FILTER (c_acctbal < 0) / count(*)::DOUBLE, 6) AS risk_ratio FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def region_overview(spark, folder):
    placed = load(spark, folder, "customer").join(load(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    risky = F.count_if(F.col("c_acctbal") < 0)
    return placed.groupBy("r_name").agg(F.count("*").alias("n_customers"), risky.alias("n_risky"), F.round(risky / F.count("*"), 6).alias("risk_ratio"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1)
    SELECT s_nationkey, s_suppkey, n, n_parts, (row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, n_parts DESC, s_suppkey))::INT AS rank FROM c JOIN supplier ON l_suppkey = s_suppkey QUALIFY rank <= 20""")
def top_partners(spark, folder):
    counted = load(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("n_parts"))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("n"), F.desc("n_parts"), "s_suppkey"))
    placed = load(spark, folder, "supplier").join(counted, F.col("l_suppkey") == F.col("s_suppkey"))
    return placed.withColumn("rank", rank).where("rank <= 20").select("s_nationkey", "s_suppkey", "n", "n_parts", "rank")


@query("""WITH m AS (SELECT o_orderpriority, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1, 2, 3)
    SELECT *, (sum(n) OVER (PARTITION BY o_orderpriority ORDER BY year, month ROWS UNBOUNDED PRECEDING))::BIGINT AS running, (rank() OVER (PARTITION BY o_orderpriority ORDER BY n DESC))::INT AS rank FROM m""")
def monthly_running(spark, folder):
    months = load(spark, folder, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    part = Window.partitionBy("o_orderpriority")
    return months.select("*", F.sum("n").over(part.orderBy("year", "month").rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.rank().over(part.orderBy(F.desc("n"))).alias("rank"))


@query("""SELECT l_partkey, count(*) FILTER (n_regionkey = 0) AS r0, count(*) FILTER (n_regionkey = 1) AS r1, count(*) FILTER (n_regionkey = 2) AS r2, count(*) FILTER (n_regionkey = 3) AS r3, count(*) FILTER (n_regionkey = 4) AS r4
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) >= 2""")
def cross_region_parts(spark, folder):
    placed = load(spark, folder, "supplier").join(load(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    counted = load(spark, folder, "lineitem").join(placed, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(*(F.count_if(F.col("n_regionkey") == r).alias(f"r{r}") for r in range(5)))
    return counted.where(sum((F.col(f"r{r}") > 0).cast("int") for r in range(5)) >= 2)


@query("""WITH m AS (SELECT o_orderpriority AS p, count(*)::DOUBLE AS n, round(avg(o_totalprice), 4) AS mean_price, count(DISTINCT o_custkey)::DOUBLE AS n_customers FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1),
    l AS (UNPIVOT m ON n, mean_price, n_customers INTO NAME metric VALUE v), w AS (SELECT metric, max(v) FILTER (p = '1-URGENT') AS a, max(v) FILTER (p = '5-LOW') AS b FROM l GROUP BY 1)
    SELECT metric, a, b, round(a - b, 4) AS difference, round(a / nullif(b, 0), 6) AS ratio FROM w""")
def metric_contrast(spark, folder):
    of = lambda p, c: F.when(F.col("o_orderpriority") == p, F.col(c))
    metrics = {"n": lambda p: F.count(of(p, "o_orderkey")).cast("double"), "mean_price": lambda p: F.round(F.avg(of(p, "o_totalprice")), 4), "n_customers": lambda p: F.count_distinct(of(p, "o_custkey")).cast("double")}
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), f("1-URGENT").alias("a"), f("5-LOW").alias("b")) for m, f in metrics.items()))
    wide = load(spark, folder, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).agg(rows.alias("rows"))
    return wide.select(F.explode("rows").alias("r")).select("r.*").select("*", F.round(F.col("a") - F.col("b"), 4).alias("difference"), F.round(F.try_divide("a", "b"), 6).alias("ratio"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min(length({c})) AS shortest, max(length({c})) AS longest, round(avg(length({c})), 4) AS mean_length, round(100.0::DOUBLE * count(*) FILTER (regexp_matches({c}, '[0-9]+$')) / count({c}), 4) AS numbered_percent FROM customer" for c in ("c_name", "c_mktsegment")))
def id_formats(spark, folder):
    def row(c):
        size = F.length(c)
        return F.struct(F.lit(c).alias("column_name"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.round(F.avg(size), 4).alias("mean_length"), F.round(100.0 * F.count_if(F.col(c).rlike("[0-9]+$")) / F.count(c), 4).alias("numbered_percent"))

    return load(spark, folder, "customer").agg(F.array(row("c_name"), row("c_mktsegment")).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def order_page(spark, folder):
    return load(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("""WITH q AS (SELECT round(quantile_cont(c_acctbal, 0.95), 6) AS a, round(quantile_cont(c_acctbal, 0.9), 6) AS b, round(quantile_cont(c_acctbal, 0.75), 6) AS c, round(quantile_cont(c_acctbal, 0.5), 6) AS d FROM customer)
    SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= a THEN 'top' WHEN c_acctbal >= b THEN 'high' WHEN c_acctbal >= c THEN 'raised' WHEN c_acctbal >= d THEN 'middle' ELSE 'low' END AS level FROM customer, q""")
def score_levels(spark, folder):
    return filters.levels(load(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", {0.95: "top", 0.9: "high", 0.75: "raised", 0.5: "middle"}, "low")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def common_ids(spark, folder):
    lines = load(spark, folder, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").intersect(lines.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT c_custkey, substr(sha256('engine' || c_custkey::VARCHAR), 1, 12) AS hashed FROM customer")
def salted_ids(spark, folder):
    return load(spark, folder, "customer").select("c_custkey", text.salted_id(F.col("c_custkey"), "engine").alias("hashed"))


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS name FROM part")
def normal_names(spark, folder):
    return load(spark, folder, "part").select("p_partkey", text.normal_name(F.col("p_type")).alias("name"))


CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(html, '{text.DROPPED}', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"SELECT page_id, length({CLEAN}) AS n_chars, md5({CLEAN}) AS digest FROM pages")
def page_texts(spark, folder):
    return load(spark, folder, "pages").select("page_id", text.clean_html(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"SELECT page_id, min(page_id) OVER (PARTITION BY md5({CLEAN})) AS first_page FROM pages WHERE html IS NOT NULL")
def page_duplicates(spark, folder):
    """The first page with the same text; one text's pages are pre-aggregated, so none is gathered."""
    hashed = load(spark, folder, "pages").where("html is not null").select("page_id", F.md5(text.clean_html(F.col("html"))).alias("digest"))
    return hashed.join(hashed.groupBy("digest").agg(F.min("page_id").alias("first_page")), "digest").select("page_id", "first_page")


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id != v.vec_id)
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id))::INT AS rank FROM p QUALIFY rank <= 5""")
def nearest_vectors(spark, folder):
    return retrieval.nearest(load(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5)


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1")
def dialogue_profile(spark, folder):
    return load(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.min_by("role", "turn").alias("first_role")
    )

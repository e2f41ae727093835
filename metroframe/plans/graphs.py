"""Queries along the edges of a graph: every order as an edge from its customer to a tenth of its own number, so that there are about ten edges a node at every size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import centrality, communities, composite, paths
from ..operators.graph import connected_components
from ..sources.tables import load
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
EDGES = "e AS MATERIALIZED (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey // 10 AS dst, round(o_totalprice, 2) AS amount, o_orderkey % 23 + 10 AS cost FROM orders)"
BOTH = "u AS MATERIALIZED (SELECT src AS a, dst AS b FROM e WHERE src != dst UNION SELECT dst, src FROM e WHERE src != dst)"
REACH = "r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)"


def edges(spark, folder):
    return load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), F.floor(F.col("o_orderkey") / 10).alias("dst"), F.round("o_totalprice", 2).alias("amount"), (F.col("o_orderkey") % 23 + 10).cast("double").alias("cost"))


def _start(spark, folder):
    return edges(spark, folder).agg(F.min("src")).first()[0]


START = "(SELECT min(src) FROM e)"


@query(f"WITH RECURSIVE {EDGES}, {BOTH}, {REACH} SELECT a AS node, min(b) AS component FROM r GROUP BY 1")
def weak_components(spark, folder):
    return connected_components(spark, edges(spark, folder).where("src != dst"), "src", "dst")


@query(f"""WITH RECURSIVE {EDGES}, {BOTH}, {REACH}, n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), d AS (SELECT node, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM n GROUP BY 1)
    SELECT count(*) AS nodes, sum(o)::BIGINT AS edges, max(o) AS most_out, max(i) AS most_in, round(avg(o + i), 6) AS mean_degree, (SELECT count(DISTINCT m) FROM (SELECT node, coalesce(min(b), node) AS m FROM d LEFT JOIN r ON a = node GROUP BY node)) AS components FROM d""")
def graph_summary(spark, folder):
    rows = edges(spark, folder)
    return paths.summary(rows, connected_components(spark, rows, "src", "dst"))


@query(f"WITH RECURSIVE {EDGES}, p(node, hop) AS (SELECT {START}, 0 UNION SELECT dst, hop + 1 FROM p JOIN e ON src = node WHERE hop < 3), l AS (SELECT node, min(hop)::INT AS hop FROM p GROUP BY 1) SELECT * FROM l WHERE hop BETWEEN 2 AND 3 AND node != {START}")
def far_neighbours(spark, folder):
    return paths.neighbours(edges(spark, folder), _start(spark, folder), 2, 3, "out")


NEAR = f"p(node, hop) AS (SELECT {START}, 0 UNION SELECT b, hop + 1 FROM p JOIN u ON a = node WHERE hop < 2), l AS (SELECT node, min(hop)::INT AS hop FROM p GROUP BY 1), g AS (SELECT a AS node, count(*) AS degree FROM u GROUP BY 1), k AS (SELECT node, hop, coalesce(degree, 0) AS degree FROM l LEFT JOIN g USING (node) ORDER BY hop, degree DESC, node LIMIT 30)"


@query(f"WITH RECURSIVE {EDGES}, {BOTH}, {NEAR} SELECT * FROM k")
def capped_nodes(spark, folder):
    return paths.subgraph(edges(spark, folder), _start(spark, folder), 2, 30)[0]


@query(f"WITH RECURSIVE {EDGES}, {BOTH}, {NEAR} SELECT id, src, dst FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def induced_edges(spark, folder):
    return paths.subgraph(edges(spark, folder), _start(spark, folder), 2, 30)[1].select("id", "src", "dst")


_PAIR = "(SELECT list(node ORDER BY n DESC, node)[1:2] FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1))"


def _pair(rows):
    ends = rows.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(2).collect()
    return [r["node"] for r in ends]


@query(f"WITH {EDGES}, t AS (SELECT {_PAIR} AS t), b AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) SELECT b AS node, count(*) FILTER (a = t[1]) AS n_one, count(*) FILTER (a = t[2]) AS n_two FROM b, t WHERE list_contains(t, a) AND NOT list_contains(t, b) GROUP BY 1 HAVING n_one > 0 AND n_two > 0")
def common_neighbours(spark, folder):
    rows = edges(spark, folder)
    return paths.common_neighbours(rows, *_pair(rows))


@query(f"WITH {EDGES}, t AS (SELECT {_PAIR} AS t), f AS (SELECT * FROM e WHERE amount > 100000), b AS (SELECT src AS a, dst AS b FROM f UNION ALL SELECT dst, src FROM f) SELECT count(*) AS n, coalesce(sum(x + y), 0)::BIGINT AS relations FROM (SELECT b, count(*) FILTER (a = t[1]) AS x, count(*) FILTER (a = t[2]) AS y FROM b, t WHERE list_contains(t, a) AND NOT list_contains(t, b) GROUP BY 1) WHERE x > 0 AND y > 0")
def filtered_common_neighbours(spark, folder):
    """Counted over relations above an amount only."""
    rows = edges(spark, folder)
    return paths.common_neighbours(rows.where("amount > 100000"), *_pair(rows)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("n_one") + F.col("n_two")), F.lit(0)).alias("relations"))


@query(f"""WITH RECURSIVE {EDGES}, t AS (SELECT {_PAIR} AS t), p(node, path) AS (SELECT t[1], [t[1]] FROM t UNION SELECT dst, list_append(path, dst) FROM p JOIN (SELECT DISTINCT src, dst FROM e) ON src = node WHERE len(path) <= 4 AND NOT list_contains(path, dst))
    SELECT path, (len(path) - 1)::INT AS hops FROM p, t WHERE node = t[2] ORDER BY len(path), path LIMIT 1""")
def path_trace(spark, folder):
    rows = edges(spark, folder)
    return paths.shortest_path(rows, *_pair(rows), 4)


@query(f"""WITH {EDGES}, t AS (SELECT {_PAIR} AS t), p AS (SELECT [x.id, y.id] AS ids, [x.amount, y.amount] AS m FROM e x JOIN e y ON x.dst = y.src AND x.id != y.id, t WHERE x.src = t[1] AND y.dst = t[2]
    UNION ALL SELECT [x.id, y.id, z.id], [x.amount, y.amount, z.amount] FROM e x JOIN e y ON x.dst = y.src AND x.id != y.id JOIN e z ON y.dst = z.src AND z.id != x.id AND z.id != y.id, t WHERE x.src = t[1] AND z.dst = t[2])
    SELECT ids, round(list_sum(m), 4) AS total, list_min(m) AS least, list_max(m) AS most, round(list_sum(m) / len(m), 4) AS mean FROM p""")
def paths_between(spark, folder):
    rows = edges(spark, folder)
    return paths.paths_between(rows, *_pair(rows), 2, 3)


@query(f"WITH RECURSIVE {EDGES}, r(a, b) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, max(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
def strong_components(spark, folder):
    return paths.strong_components(edges(spark, folder))


def _rank_sql(steps):
    made = [f"{EDGES}, l AS (SELECT DISTINCT src, dst FROM e), o AS (SELECT src, count(*) AS o FROM l GROUP BY 1), n AS (SELECT src AS node FROM l UNION SELECT dst FROM l), c AS (SELECT count(*) AS c FROM n), k0 AS (SELECT node, 1.0::DOUBLE / c AS k FROM n, c)"]
    for i in range(steps):
        made.append(
            f"g{i} AS (SELECT dst AS node, sum(k / o) AS g FROM l JOIN o USING (src) JOIN k{i} ON node = src GROUP BY 1), k{i + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / c + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(k), 0) FROM k{i} WHERE node NOT IN (SELECT src FROM l)) / c) AS k FROM n LEFT JOIN g{i} USING (node), c)"
        )
    return f"WITH {', '.join(made)} SELECT node, round(k, 8) AS rank FROM k{steps}"


@query(_rank_sql(10))
def page_ranks(spark, folder):
    return paths.page_rank(edges(spark, folder), steps=10, tolerance=0.0).select("node", F.round("rank", 8).alias("rank"))


@query(f"""WITH RECURSIVE {EDGES}, l AS MATERIALIZED (SELECT DISTINCT src, dst FROM e), s AS (SELECT DISTINCT dst AS node FROM e ORDER BY 1 LIMIT 5), r(source, node, hop) AS (SELECT node, node, 0 FROM s UNION SELECT source, src, hop + 1 FROM r JOIN l ON dst = r.node WHERE hop < 12),
    d AS (SELECT source, node, min(hop) AS hop FROM r GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)) SELECT source AS node, round(coalesce((count(*) - 1) * (count(*) - 1) / nullif(sum(hop) * (max(n) - 1), 0)::DOUBLE, 0), 6) AS closeness FROM d, n GROUP BY 1""")
def closeness(spark, folder):
    rows = edges(spark, folder)
    return paths.closeness(rows, rows.select(F.col("dst").alias("node")).distinct().orderBy("node").limit(5))


@query(f"WITH RECURSIVE {EDGES}, l AS MATERIALIZED (SELECT src, dst, min(cost) AS cost FROM e GROUP BY 1, 2), p(node, cost) AS (SELECT {START}, 0::BIGINT UNION SELECT dst, p.cost + l.cost FROM p JOIN l ON src = node WHERE p.cost + l.cost <= 60) SELECT node, min(cost)::DOUBLE AS cost FROM p GROUP BY 1")
def travel_times(spark, folder):
    """What a start reaches within an hour, each edge with its own minutes."""
    return paths.reachable(edges(spark, folder), _start(spark, folder), 60.0)


@query(f"WITH {EDGES} SELECT count(*) AS n_edges, count(DISTINCT (src, dst)) AS n_directed, count(DISTINCT (least(src, dst), greatest(src, dst))) FILTER (src != dst) AS n_undirected FROM e")
def unique_edges(spark, folder):
    rows = edges(spark, folder)
    pair = F.when(F.col("src") != F.col("dst"), F.struct(F.least("src", "dst"), F.greatest("src", "dst")))
    return rows.agg(F.count("*").alias("n_edges"), F.count_distinct(F.struct("src", "dst")).alias("n_directed"), F.count_distinct(pair).alias("n_undirected"))


# Communities: any orders link a customer and what it ordered from; nodes of the two ends share their numbers.
@query(f"""WITH {EDGES}, l AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src != dst), b AS (SELECT u AS a, v AS b FROM l UNION ALL SELECT v, u FROM l),
    p AS (SELECT a % 25 AS c, count(*) AS k, count(*) FILTER (a % 25 = b % 25) AS i, count(DISTINCT a) AS n FROM b GROUP BY 1)
    SELECT round(sum(i) / sum(k)::DOUBLE - sum(k * k) / (sum(k) * sum(k))::DOUBLE, 8) AS modularity, count(*) AS communities, sum(n)::BIGINT AS nodes FROM p""")
def partition_modularity(spark, folder):
    """How far customers' numbers modulo 25 are a partition by who orders what."""
    rows = edges(spark, folder)
    nodes = rows.where("src != dst").select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = communities.modularity(communities.undirected_links(rows), nodes.select("node", (F.col("node") % 25).alias("community")))
    return found.withColumn("modularity", F.round("modularity", 8))


def louvain_communities(spark, folder):
    """Communities of buyers and what they order from, by Louvain's method, with the links inside and outside of each."""
    rows = edges(spark, folder)
    found = communities.louvain(rows, seed=1, steps=10, tolerance=1e-3)
    return communities.statistics(communities.undirected_links(rows), found)


QUERIES["louvain_communities"] = louvain_communities


def between_sql(links, levels):
    """Betweenness of the nodes of a table of links (a, b), both ways, that has no shortest path of more than so many steps: CTEs that end in m (node, betweenness, degree)."""
    made = [f"d0 AS (SELECT DISTINCT a AS s, a AS v, 1.0::DOUBLE AS n FROM {links})"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, v FROM d{j}" for j in range(i))
        made.append(f"d{i} AS MATERIALIZED (SELECT s, b AS v, sum(n) AS n FROM d{i - 1} JOIN {links} ON a = v WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.s = d{i - 1}.s AND x.v = {links}.b) GROUP BY ALL)")
    made.append("d AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, v, n, {i} AS d FROM d{i}" for i in range(1, levels + 1)) + ")")
    made.append("z AS (SELECT x.v AS node, sum(x.n * y.n / w.n) AS part FROM d x JOIN d y ON x.v = y.s JOIN d w ON w.s = x.s AND w.v = y.v WHERE x.d + y.d = w.d GROUP BY 1)")
    made.append(f"g AS (SELECT a AS node, count(*) AS degree FROM {links} GROUP BY 1)")
    made.append("m AS (SELECT node, coalesce(part, 0) / greatest(1, (SELECT (count(*) - 1) * (count(*) - 2) FROM g)) AS betweenness, degree FROM g LEFT JOIN z USING (node))")
    return ", ".join(made)


AROUND = f"""{EDGES}, {BOTH}, p(node, hop) AS (SELECT {START}, 0 UNION SELECT b, hop + 1 FROM p JOIN u ON a = node WHERE hop < 2), l AS (SELECT node, min(hop) AS hop FROM p GROUP BY 1), deg AS (SELECT a AS node, count(*) AS deg FROM u GROUP BY 1),
    k AS MATERIALIZED (SELECT node FROM l JOIN deg USING (node) ORDER BY hop, deg DESC, node LIMIT 300), w AS MATERIALIZED (SELECT a, b FROM u WHERE a IN (FROM k) AND b IN (FROM k))"""


def around(spark, folder):
    rows = edges(spark, folder)
    start = _start(spark, folder)
    return start, centrality.neighbourhood(rows, spark.createDataFrame([(start,)], "node long"), 2, 300)


@query(f"WITH RECURSIVE {AROUND}, {between_sql('w', 4)} SELECT node, round(betweenness, 6) AS betweenness, degree FROM m")
def betweenness(spark, folder):
    """Of the 300 nodes nearest to a start, how many shortest paths between others lead through each."""
    return centrality.betweenness(around(spark, folder)[1]).withColumn("betweenness", F.round("betweenness", 6))


_MARKED = f"(SELECT DISTINCT y.src AS node FROM e x JOIN e y ON x.dst = y.dst WHERE x.src = {START} AND y.src != {START})"


def _marked(spark, folder, start):
    """Who ordered from where the start did."""
    rows = edges(spark, folder)
    mine = rows.where(F.col("src") == start).select("dst").distinct()
    return rows.join(mine, "dst", "left_semi").where(F.col("src") != start).select(F.col("src").alias("node")).distinct()


@query(f"""WITH RECURSIVE {AROUND}, {between_sql('w', 4)}, o AS (SELECT node, round(betweenness, 6) AS betweenness, degree FROM m)
    SELECT * FROM (SELECT 'local_hub' AS role, row_number() OVER (ORDER BY degree DESC, node DESC)::INT AS rank, node, degree, betweenness FROM o WHERE node != {START} ORDER BY rank LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'bridge_node', row_number() OVER (ORDER BY betweenness DESC, degree DESC, node DESC)::INT AS rank, node, degree, betweenness FROM o WHERE node != {START} ORDER BY rank LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'shared_device_related', row_number() OVER (ORDER BY s.node)::INT AS rank, s.node, coalesce(degree, 0), coalesce(betweenness, 0) FROM {_MARKED} s LEFT JOIN o USING (node) ORDER BY rank LIMIT 10)""")
def key_roles(spark, folder):
    start, links = around(spark, folder)
    return centrality.key_roles(links, start, _marked(spark, folder, start))


@query(f"""WITH RECURSIVE {AROUND}, {between_sql('w', 4)}, s AS {_MARKED}, r AS (SELECT node, degree, betweenness, node IN (FROM s) AS marked FROM m WHERE node != {START}),
    o AS (SELECT node, degree, round(betweenness, 6) AS betweenness, list_filter([CASE WHEN marked THEN 'shared_device_related' END, CASE WHEN degree >= 2 THEN 'multi_link_neighbor' END, CASE WHEN betweenness > 0 THEN 'bridge_like' END], lambda x: x IS NOT NULL) AS roles,
    round(CASE WHEN marked THEN 5 ELSE 0 END + degree + betweenness * 10, 6) AS score FROM r) SELECT *, row_number() OVER (ORDER BY score DESC, degree DESC, node DESC)::INT AS rank FROM o WHERE len(roles) > 0 ORDER BY rank LIMIT 10""")
def suspicious_nodes(spark, folder):
    start, links = around(spark, folder)
    return centrality.suspicious_nodes(links, start, _marked(spark, folder, start))


# Composite paths: orders are calls, parts that two customers ordered are devices.
RELATED = """e AS MATERIALIZED (SELECT o_custkey AS src, o_orderkey // 10 AS dst FROM orders), dv AS MATERIALIZED (SELECT DISTINCT o_custkey AS member, l_partkey AS device FROM orders JOIN lineitem ON l_orderkey = o_orderkey), cp AS MATERIALIZED (SELECT DISTINCT src, dst FROM e),
    pa AS MATERIALIZED (SELECT src AS node, dst AS other, 'call' AS relation, 0 AS o, count(*) AS evidence, NULL AS sample FROM e GROUP BY 1, 2
        UNION ALL SELECT x.member, y.member, 'shared_device', 1, count(*), min(y.device)::VARCHAR FROM dv x JOIN dv y ON x.device = y.device AND x.member != y.member GROUP BY 1, 2
        UNION ALL SELECT x.src, y.src, 'common_counterparty', 2, count(*), min(y.dst)::VARCHAR FROM cp x JOIN cp y ON x.dst = y.dst AND x.src != y.src GROUP BY 1, 2 HAVING count(*) >= 2),
    wo AS (SELECT *, CASE o WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 2 END * ln(1 + evidence) AS worth FROM pa),
    fi AS (SELECT *, row_number() OVER (PARTITION BY node, o ORDER BY evidence DESC, other) AS r FROM wo QUALIFY r <= 20),
    st AS MATERIALIZED (SELECT node, other, arg_max(relation, (worth, -o)) AS relation, arg_max(struct_pack(s := sample), (worth, -o)).s AS sam, max(worth) AS worth, min(o * 1000000 + r) AS place FROM fi GROUP BY 1, 2)"""


def composite_sql(source, target, order="score DESC, hops"):
    """Paths of at most three hops, 500 followed."""
    grow = lambda b: f"SELECT other AS node, list_append(path, other) AS path, list_append(relations, st.relation) AS relations, list_append(evidence, st.sam) AS evidence, score + st.worth AS score, list_append(places, place) AS places FROM {b} b JOIN st ON st.node = b.node WHERE NOT list_contains(path, other)"
    return f"""{RELATED}, t AS MATERIALIZED (SELECT {source} AS s, {target} AS t),
    b0 AS (SELECT s AS node, [s] AS path, []::VARCHAR[] AS relations, []::VARCHAR[] AS evidence, 0.0::DOUBLE AS score, []::BIGINT[] AS places FROM t), n1 AS MATERIALIZED ({grow('b0')}),
    b1 AS MATERIALIZED (SELECT n1.* FROM n1, t WHERE node != t.t), n2 AS MATERIALIZED ({grow('b1')}), c2 AS (SELECT n2.* FROM n2, t WHERE node != t.t AND node != t.s AND node NOT IN (SELECT node FROM b1)),
    b2 AS MATERIALIZED (SELECT * FROM c2 ORDER BY places LIMIT (SELECT greatest(0, 499 - count(*)) FROM b1)), n3 AS MATERIALIZED ({grow('b2')}),
    di AS (SELECT other AS node, [node, other] AS path, [relation] AS relations, [sample] AS evidence, worth AS score, [o] AS places FROM wo, t WHERE node = t.s AND other = t.t),
    al AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3),
    fo AS (SELECT * FROM di UNION ALL SELECT al.* FROM al, t WHERE node = t.t AND NOT EXISTS (FROM di)),
    an AS (SELECT path, relations, evidence, len(relations)::INT AS hops, round(score - 0.3 * len(relations), 6) AS score, places FROM fo),
    tp AS MATERIALIZED (SELECT path, relations, evidence, hops, score, row_number() OVER (ORDER BY {order}, places)::INT AS rank FROM an QUALIFY rank <= 10)"""


def related(spark, folder):
    rows = edges(spark, folder)
    devices = load(spark, folder, "orders").join(load(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("member"), F.col("l_partkey").alias("device"))
    return composite.Relations(rows.select("src", "dst"), devices)


#: Whom to look for: the first buyer that isn't related to the first of all, or the one that shares most devices with it.
FAR = ("(SELECT min(src) FROM e)", "(SELECT min(src) FROM e WHERE src > (SELECT min(src) FROM e) AND src NOT IN (SELECT other FROM pa WHERE node = (SELECT min(src) FROM e)))")
NEXT = ("(SELECT min(src) FROM e)", "(SELECT other FROM pa WHERE node = (SELECT min(src) FROM e) AND other != node AND o = 1 ORDER BY evidence DESC, other LIMIT 1)")


def _far(spark, folder, strategy):
    found = related(spark, folder)
    source = found.calls.agg(F.min("src")).first()[0]
    near = found.partners(spark.createDataFrame([(source,)], "node long")).select(F.col("other").alias("src"))
    target = found.calls.where(F.col("src") > source).join(near, "src", "left_anti").agg(F.min("src")).first()[0]
    return composite.find(found, source, target, strategy=strategy)[0]


@query(f"WITH {composite_sql(*FAR)} SELECT path, relations, evidence, hops, score, rank FROM tp")
def composite_paths(spark, folder):
    """Strongest paths of calls, shared devices and common counterparts."""
    return _far(spark, folder, "balanced")


@query(f"WITH {composite_sql(*FAR, order='hops, score DESC')} SELECT path, relations, evidence, hops, score, rank FROM tp")
def shortest_composite_paths(spark, folder):
    return _far(spark, folder, "shortest")


@query(f"WITH {composite_sql(*NEXT)} SELECT path, relations, evidence, hops, score, rank FROM tp")
def direct_relations(spark, folder):
    """Two that share devices: their relations are the answer, without a search."""
    found = related(spark, folder)
    source = found.calls.agg(F.min("src")).first()[0]
    near = found.partners(spark.createDataFrame([(source,)], "node long")).where("other != node AND relation = 'shared_device'")
    return composite.find(found, source, near.orderBy(F.desc("evidence"), "other").first()["other"])[0]


@query(f"WITH {RELATED}, a AS (SELECT min(src) AS a FROM e UNION SELECT max(src) FROM e) SELECT node, other, relation, evidence, sample, round(worth, 6) AS worth, place FROM (SELECT node, other, relation, sam AS sample, worth, place FROM st) JOIN pa USING (node, other, relation, sample) WHERE node IN (FROM a) UNION ALL SELECT s.node, s.other, s.relation, pa.evidence, NULL, round(s.worth, 6), s.place FROM st s JOIN pa ON pa.node = s.node AND pa.other = s.other AND pa.relation = s.relation WHERE s.sam IS NULL AND s.node IN (FROM a)")
def composite_steps(spark, folder):
    """What two nodes are followed to: the first twenty of each relation, the best relation to each partner."""
    found = related(spark, folder)
    ends = found.calls.agg(F.array(F.min("src"), F.max("src")).alias("a")).select(F.explode("a").alias("node")).distinct()
    return found.steps(ends).withColumn("worth", F.round("worth", 6))


@query(f"""WITH {composite_sql(*FAR)}, ep AS (SELECT path[i] AS a, path[i + 1] AS b FROM (SELECT path, unnest(range(1, len(path))) AS i FROM tp)), w AS MATERIALIZED (SELECT a, b FROM ep UNION SELECT b, a FROM ep), {between_sql('w', 6)},
    f AS (SELECT node, count(*) AS path_frequency FROM (SELECT unnest(path[2:-2]) AS node FROM tp WHERE len(path) > 2) GROUP BY 1)
    SELECT node, path_frequency, round(betweenness, 6) AS betweenness, degree, round(path_frequency * 3 + betweenness * 10 + degree * 0.05, 6) AS score FROM f JOIN m USING (node) ORDER BY score DESC, node LIMIT 10""")
def bridge_ranking(spark, folder):
    """What stands inside the strongest composite paths."""
    return centrality.bridge_ranking(_far(spark, folder, "balanced"))


@query(f"""WITH {composite_sql(*FAR)}, sp AS (SELECT path[i]::VARCHAR AS a, path[i + 1]::VARCHAR AS b, evidence[i] AS x FROM (SELECT path, evidence, unnest(range(1, len(path))) AS i FROM tp)), ep AS (SELECT a, b FROM sp UNION SELECT a, x FROM sp WHERE x IS NOT NULL UNION SELECT x, b FROM sp WHERE x IS NOT NULL),
    w AS MATERIALIZED (SELECT a, b FROM ep WHERE a != b UNION SELECT b, a FROM ep WHERE a != b), {between_sql('w', 6)}, f AS (SELECT node, count(*) AS path_frequency FROM (SELECT unnest(path[2:-2])::VARCHAR AS node FROM tp WHERE len(path) > 2 UNION ALL SELECT x FROM sp WHERE x IS NOT NULL) GROUP BY 1)
    SELECT node, path_frequency, round(betweenness, 6) AS betweenness, degree, round(path_frequency * 10 + betweenness * 5 + degree, 6) AS score FROM f JOIN m USING (node) ORDER BY score DESC, node LIMIT 10""")
def evidence_bridges(spark, folder):
    """The same with the devices and counterparts that steps rest on."""
    return centrality.evidence_bridges(_far(spark, folder, "balanced"))

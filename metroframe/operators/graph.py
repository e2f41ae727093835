"""Measures of graphs given as edges: counts, degrees, peers through shared items, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut


def edge_counts(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Rows, different directed edges, and pairs of sources that share a target (counted, never made)."""
    unique = edges.groupBy(src, dst).agg(F.count("*").alias("n"))
    per_target = unique.groupBy(dst).agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    return per_target.agg(F.sum("n").alias("n_edges"), F.sum("m").alias("n_unique"), F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")).alias("n_incident_pairs"))


def degree_centrality(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Different neighbours of each node, and their share of all other nodes. Loops don't count."""
    a, b = F.col(src).alias("node"), F.col(dst).alias("other")
    ends = F.array(F.struct(a, b), F.struct(F.col(dst).alias("node"), F.col(src).alias("other")))
    degrees = edges.where(F.col(src) != F.col(dst)).select(F.explode(ends).alias("e")).select("e.*").distinct().groupBy("node").agg(F.count("*").alias("degree"))
    total = degrees.agg(F.count("*").alias("_n"))
    return degrees.crossJoin(F.broadcast(total)).select("node", "degree", F.round(F.try_divide(F.col("degree"), F.col("_n") - 1), 6).alias("centrality"))


def item_sharing(edges: DataFrame, member: str, item: str) -> DataFrame:
    """How many items have at least 2, 5 and 10 different members, and the most that one has."""
    sizes = edges.select(member, item).distinct().groupBy(item).agg(F.count("*").alias("k"))
    return sizes.agg(F.count("*").alias("n_items"), *(F.count_if(F.col("k") >= n).alias(f"at_least_{n}") for n in (2, 5, 10)), F.max("k").alias("most"))


def partner_metrics(edges: DataFrame, member: str, item: str) -> DataFrame:
    """Items of each member, those it shares, and the sum of other members over its items."""
    one = edges.select(member, item).distinct()
    sizes = one.groupBy(item).agg(F.count("*").alias("k"))
    return one.join(sizes, item).groupBy(member).agg(F.count("*").alias("n_items"), F.count_if(F.col("k") >= 2).alias("n_shared"), F.sum(F.col("k") - 1).alias("n_peers"))


def strongest_partner(edges: DataFrame, member: str, partner: str) -> DataFrame:
    """The partner with the most rows for each member, the least of ties."""
    counted = edges.groupBy(member, partner).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(partner).alias("p"))).alias("b")
    return counted.groupBy(member).agg(best).select(member, F.col("b.p").alias("partner"), (-F.col("b.n")).alias("times"))


#: A node with more links than this, and than one in so many of all links, has its join spread over SALTS tasks; there are at most HEAVY such nodes.
HEAVY, SALTS = 50_000, 64


def _to_least(rows: DataFrame, n_links: int, kept: str | None) -> DataFrame:
    """For rows (u, v), those that are kept of them, the pairs (v, m), m the least of u and all its v.

    The least is found by a grouping with partial results. Nodes with most of the links, which a large component has many of towards its end, are marked by a broadcast of
    those nodes alone (their number has a bound, see HEAVY), and their rows meet copies of the one row that they need under a salted key."""
    found = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
    rows = rows.where(kept) if kept else rows
    bound = max(HEAVY, n_links // HEAVY)
    if n_links <= bound:
        return rows.join(found, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    heavy = found.where(F.col("_n") > bound).select("u", F.lit(SALTS).alias("_salts"))
    salted = rows.join(F.broadcast(heavy), "u", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("v"), F.col("_salts")), F.lit(0)).cast("int"))
    copies = found.withColumn("_salt", F.explode(F.when(F.col("_n") > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, ["u", "_salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(spark: SparkSession, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Each node with the least node of its component. Nulls are no nodes; a loop makes a component of one.

    Alternating large-star and small-star steps: a node's larger neighbours, then its smaller ones, are linked to the least of them. Each step is one
    grouping for the least neighbour and one join, neighbours are never listed, and steps end when the links no longer change; their number grows with
    the logarithm of the longest path. Links are written after each step, so a lost executor costs one step at most."""
    valid = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    nodes = cut(spark, valid.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    links = cut(spark, valid.where("u != v").distinct())
    state, n_links = None, links.count()
    while True:
        both = links.union(links.select("v", "u"))
        larger = _to_least(both, 2 * n_links, "v > u")
        large = cut(spark, larger.where("u != v").distinct())
        n_large = large.count()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_least(large, n_large, None).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        links = cut(spark, small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n_links = now, now[0]
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))

"""Betweenness by Brandes' two passes as joins, and rankings of bridges and roles that rest on it.

Forward, the border of all sources at once meets the links and counts shortest paths level by level; backward, each level hands its
share of dependency to the level before. Levels are written as they are made. The work is sources times links, so a graph of any size
is asked about a set of sources, or cut down to the part around some nodes first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, forget
from .paths import levels, undirected


def neighbourhood(edges: DataFrame, centres: DataFrame, radius: int, most: int) -> DataFrame:
    """Undirected links (src, dst), each both ways, between the nodes within some steps of any centre (column node): the nearest most of
    them, of equally near ones those of greatest degree, then the least. As nearer nodes come first, each keeps its way to a centre."""
    both = undirected(edges)
    near = levels(both, centres, radius).groupBy("node").agg(F.min("hop").alias("hop"))
    degrees = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    kept = cut(edges.sparkSession, near.join(degrees, "node").orderBy("hop", F.desc("degree"), "node").limit(most).select("node"))
    return both.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness, degree) of all nodes with a link: the share of shortest paths between other nodes that lead through a node, normalised, links undirected.

    With sources (column node), only paths from those count, and the sum is scaled up to all nodes: an estimate, exact if all are given.
    Loops, repeated edges and edges with a null end don't count. With fewer than three nodes all are 0."""
    spark = edges.sparkSession
    both = cut(spark, undirected(edges))
    nodes = cut(spark, both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    asked = nodes if sources is None else nodes.join(sources.select("node").distinct(), "node", "left_semi")
    n, n_asked = nodes.count(), asked.count()
    layers = [cut(spark, asked.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")))]
    while True:
        new = layers[-1].join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        for before in layers[-2:]:  # a neighbour is a level before, on the same level, or the next one
            new = new.join(before.select("source", "node"), ["source", "node"], "left_anti")
        layers.append(cut(spark, new))
        if layers[-1].isEmpty():
            forget(layers.pop())
            break
    below, made = None, []
    for layer in reversed(layers[1:]):
        if below is None:
            found = layer.withColumn("part", F.lit(0.0))
        else:
            sent = below.join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum((1.0 + F.col("part")) / F.col("paths")).alias("got"))
            found = layer.join(sent, ["source", "node"], "left").select("source", "node", "paths", (F.col("paths") * F.coalesce("got", F.lit(0.0))).alias("part"))
        below = cut(spark, found)
        made.append(below)
    total = nodes.select("node", F.lit(0.0).alias("part"))
    for found in made:
        total = total.unionByName(found.select("node", "part"))
    scale = n / n_asked / ((n - 1) * (n - 2)) if n > 2 and n_asked else 0.0
    sums = total.groupBy("node").agg((F.sum("part") * scale).alias("betweenness"))
    out = cut(spark, nodes.join(sums, "node").select("node", "betweenness", "degree"))
    forget(both, nodes, *layers, *made)
    return out


def bridge_ranking(paths: DataFrame, frequency: float = 3.0, between: float = 10.0, degree: float = 0.05, radius: int = 2, most: int = 300, top: int = 10) -> DataFrame:
    """Nodes inside paths (column path: array of nodes) by how often they stand in one, their betweenness and degree in the paths' own graph around them.

    (node, path_frequency, betweenness, degree, score), the first top by falling score, then node. Paths of fewer than three nodes have nothing inside."""
    steps = paths.select(F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("src"), F.expr("slice(path, 2, size(path) - 1)").alias("dst"))).alias("e")).select("e.src", "e.dst")
    inside = paths.where(F.size("path") > 2).select(F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("node")).groupBy("node").agg(F.count("*").alias("path_frequency"))
    inside = cut(paths.sparkSession, inside)
    measured = betweenness(neighbourhood(steps, inside.select("node"), radius, most))
    return _scored(inside, measured, frequency, between, degree, top)


def _scored(counted: DataFrame, measured: DataFrame, frequency: float, between: float, degree: float, top: int) -> DataFrame:
    rows = counted.join(measured, "node", "left").select("node", "path_frequency", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("degree", F.lit(0)).alias("degree"))
    score = F.col("path_frequency") * frequency + F.col("betweenness") * between + F.col("degree") * degree
    return rows.select("node", "path_frequency", F.round("betweenness", 6).alias("betweenness"), "degree", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "node").limit(top)


def evidence_bridges(paths: DataFrame, top: int = 10) -> DataFrame:
    """The report's variant: what a step rests on (column evidence, one for each step, null for none) is a bridge as well, linked to both ends of the step.

    Scores are ten times the frequency, the degree, and five times the betweenness, over the whole graph of the paths and their evidence."""
    text = paths.select(F.transform("path", lambda x: x.cast("string")).alias("path"), "evidence")
    step = F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("src"), F.expr("slice(path, 2, size(path) - 1)").alias("dst"), F.col("evidence"))).alias("e")
    steps = cut(paths.sparkSession, text.select(step).select("e.*"))
    rests = steps.where("evidence IS NOT NULL")
    inner = text.where(F.size("path") > 2).select(F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("node"))
    counted = inner.union(rests.select("evidence")).groupBy("node").agg(F.count("*").alias("path_frequency"))
    graph = steps.select("src", "dst").union(rests.select("src", "evidence")).union(rests.select("evidence", "dst"))
    return _scored(counted, betweenness(graph), 10.0, 5.0, 1.0, top)


def key_roles(links: DataFrame, centre, marked: DataFrame, top: int = 10) -> DataFrame:
    """(role, rank, node, degree, betweenness): hubs by degree, bridges by betweenness, and the first of marked (column node), but for bridges without the centre.

    Ties go to the greater degree, then the greater node, as hubs and bridges are sorted downwards."""
    near = cut(links.sparkSession, betweenness(links).withColumn("betweenness", F.round("betweenness", 6)))
    others = near.where(F.col("node") != centre)
    hubs = others.orderBy(F.desc("degree"), F.desc("node")).limit(top).withColumns({"role": F.lit("local_hub"), "rank": F.row_number().over(Window.orderBy(F.desc("degree"), F.desc("node")))})
    by = [F.desc("betweenness"), F.desc("degree"), F.desc("node")]
    bridges = others.orderBy(*by).limit(top).withColumns({"role": F.lit("bridge_node"), "rank": F.row_number().over(Window.orderBy(*by))})
    first = marked.select("node").distinct().orderBy("node").limit(top)
    shared = first.join(near, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
    shared = shared.withColumns({"role": F.lit("shared_device_related"), "rank": F.row_number().over(Window.orderBy("node"))})
    columns = ["role", "rank", "node", "degree", "betweenness"]
    return hubs.select(columns).unionByName(bridges.select(columns)).unionByName(shared.select(columns))


def suspicious_nodes(links: DataFrame, centre, marked: DataFrame, top: int = 10) -> DataFrame:
    """(rank, node, degree, betweenness, roles, score): nodes other than the centre that share a device (marked), have two links or more, or lie between others."""
    near = betweenness(links).where(F.col("node") != centre).join(marked.select("node", F.lit(True).alias("_marked")).distinct(), "node", "left")
    is_marked = F.coalesce("_marked", F.lit(False))
    roles = F.array_compact(F.array(F.when(is_marked, "shared_device_related"), F.when(F.col("degree") >= 2, "multi_link_neighbor"), F.when(F.col("betweenness") > 0, "bridge_like")))
    score = F.round(F.when(is_marked, 5).otherwise(0) + F.col("degree") + F.col("betweenness") * 10, 6)
    rows = near.select("node", "degree", F.round("betweenness", 6).alias("betweenness"), roles.alias("roles"), score.alias("score")).where(F.size("roles") > 0)
    by = [F.desc("score"), F.desc("degree"), F.desc("node")]
    return rows.orderBy(*by).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*by)))

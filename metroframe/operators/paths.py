"""Searches along edges (src, dst): levels, paths, subgraphs, strong components, ranks of pages, travel times.

Each step is a join of the border with the edges, and is written before the next one, so a lost executor costs one step. Only the
border meets the edges; what has been reached is a table, never a list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def levels(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, hop): the least number of steps from each source (column node) to what it reaches, itself with 0."""
    spark = edges.sparkSession
    steps = cut(spark, edges.select("src", "dst").distinct())
    border = cut(spark, sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hop")).distinct())
    reached = border
    while most is None or most > 0:
        new = border.join(steps, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("hop") + 1).alias("hop")).distinct()
        border = cut(spark, new.join(reached.select("source", "node"), ["source", "node"], "left_anti"))
        if border.isEmpty():
            break
        reached = reached.unionByName(border)
        most = None if most is None else most - 1
    return reached


def neighbours(edges: DataFrame, start, least: int, most: int, direction: str) -> DataFrame:
    """Nodes from least to most steps away along edges that go out, come in, or both; never the start itself."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    used = {"out": edges.select("src", "dst"), "in": flipped, "both": undirected(edges)}[direction]
    one = edges.sparkSession.createDataFrame([(start,)], "node long")
    return levels(used, one, most).where(F.col("hop").between(least, most) & (F.col("node") != start)).select("node", "hop")


def subgraph(edges: DataFrame, centre, hops: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hop, degree) within some steps, whichever way edges go, the nearest first, then those of greatest degree, then by number, the centre always; and the edges between them."""
    both = undirected(edges)
    near = levels(both, edges.sparkSession.createDataFrame([(centre,)], "node long"), hops).select("node", "hop")
    degrees = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    nodes = near.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = cut(edges.sparkSession, nodes.orderBy("hop", F.desc("degree"), "node").limit(most))
    ids = kept.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inside


def common_neighbours(edges: DataFrame, one, two) -> DataFrame:
    """Nodes next to both, with the edges of each to them."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    near = both.where(F.col("src").isin(one, two) & ~F.col("dst").isin(one, two))
    counted = near.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("src") == one).alias("n_one"), F.count_if(F.col("src") == two).alias("n_two"))
    return counted.where("n_one > 0 AND n_two > 0")


def shortest_path(edges: DataFrame, start, end, most: int) -> DataFrame:
    """One shortest path of at most so many steps, the first by its nodes: (path, hops), no row if there is none."""
    spark = edges.sparkSession
    steps = cut(spark, edges.select("src", "dst").distinct())
    border = spark.createDataFrame([(start, [start])], "node long, path array<long>")
    seen = border.select("node")
    for hop in range(1, most + 1):
        if start == end:
            break
        new = border.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        border = cut(spark, new.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if border.isEmpty() or not border.where(F.col("node") == end).isEmpty():
            break
        seen = seen.union(border.select("node"))
    return border.where(F.col("node") == end).select("path", (F.size("path") - 1).alias("hops"))


def paths_between(edges: DataFrame, start, end, least: int, most: int) -> DataFrame:
    """All paths of least to most edges (id, src, dst, amount) that repeat no edge: their edges, total, least, greatest and mean amount. Their number grows with the power of the degree; keep most small."""
    step = edges.select("id", "src", "dst", "amount")
    border = step.where(F.col("src") == start).select(F.col("dst").alias("node"), F.array("id").alias("ids"), F.array("amount").alias("amounts"))
    found = border
    for _ in range(most - 1):
        border = border.join(step, F.col("node") == F.col("src")).where(~F.array_contains("ids", F.col("id")))
        border = cut(edges.sparkSession, border.select(F.col("dst").alias("node"), F.concat("ids", F.array("id")).alias("ids"), F.concat("amounts", F.array("amount")).alias("amounts")))
        found = found.unionByName(border)
    total = F.aggregate("amounts", F.lit(0.0), lambda s, x: s + x)
    return found.where((F.col("node") == end) & (F.size("ids") >= least)).select("ids", F.round(total, 4).alias("total"), F.array_min("amounts").alias("least"), F.array_max("amounts").alias("most"), F.round(total / F.size("amounts"), 4).alias("mean"))


def strong_components(edges: DataFrame) -> DataFrame:
    """Each node with the greatest node of those that it reaches and that reach it.

    Colours: the greatest node that reaches a node. A colour's own node and what reaches it inside the colour are a component; it goes, and the rest is coloured anew."""
    spark = edges.sparkSession
    left = cut(spark, edges.select("src", "dst").where("src != dst").distinct())
    nodes = cut(spark, edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    while True:
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            sent = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("other"))
            new = cut(spark, colour.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("other", "colour")).alias("colour"), (F.coalesce("other", "colour") > F.col("colour")).alias("moved")))
            colour = new.select("node", "colour")
            if new.where("moved").isEmpty():
                break
        ends = left.join(colour.toDF("src", "c1"), "src").join(colour.toDF("dst", "c2"), "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = levels(ends, colour.where("node = colour").select("node")).select("node", F.col("source").alias("component"))
        found = cut(spark, found)
        done = found if done is None else cut(spark, done.unionByName(found))
        nodes = cut(spark, nodes.join(found, "node", "left_anti"))
        if nodes.isEmpty():
            return done
        ids = nodes.select("node")
        left = cut(spark, left.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def page_rank(edges: DataFrame, damping: float = 0.85, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """The share of a random walk's time at each node; nodes without a way out send what they have to all. Ends when ranks move by less than tolerance a node. Written every fifth step."""
    spark = edges.sparkSession
    one = edges.select("src", "dst").distinct()
    links = cut(spark, one.join(one.groupBy("src").agg(F.count("*").alias("out")), "src"))
    nodes = cut(spark, one.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(one.select(F.col("src").alias("node"), F.lit(True).alias("leads")).distinct(), "node", "left"))
    n = nodes.count()
    rank = nodes.select("node", "leads", F.lit(1.0 / max(1, n)).alias("rank"))
    for step in range(1, steps + 1):
        got = links.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        stuck = rank.agg(F.coalesce(F.sum(F.when(F.col("leads").isNull(), F.col("rank"))), F.lit(0.0)).alias("stuck"))
        new = rank.join(got, "node", "left").crossJoin(F.broadcast(stuck))
        value = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("stuck") / n)
        new = new.select("node", "leads", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved"))
        if step % 5 == 0 or step == steps:
            new = cut(spark, new)
            if (new.agg(F.sum("moved")).first()[0] or 0.0) < n * tolerance:
                return new.select("node", "rank")
        rank = new.select("node", "leads", "rank")
    return rank.select("node", "rank")


def closeness(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each node asked about (column node): how near it is to those that reach it, times the share of all nodes that do."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    sums = levels(flipped, asked).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("r"), F.sum("hop").alias("d"))
    r = F.col("r") - 1
    return sums.select("node", F.round(F.coalesce(F.try_divide(r * r, F.col("d") * F.lit(max(1, n - 1))), F.lit(0.0)), 6).alias("closeness"))


def reachable(edges: DataFrame, origin, budget: float) -> DataFrame:
    """Least cost from the origin to each node within a budget, along edges (src, dst, cost). Costs are lowered step by step; only nodes whose cost fell go on."""
    spark = edges.sparkSession
    steps = cut(spark, edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    best = cut(spark, spark.createDataFrame([(origin, 0.0)], "node long, cost double"))
    border = best
    while not border.isEmpty():
        went = border.withColumnRenamed("cost", "before").join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("before") + F.col("cost")).alias("cost"))
        found = went.where(F.col("cost") <= budget).groupBy("node").agg(F.min("cost").alias("new"))
        merged = cut(spark, best.join(found, "node", "full").select("node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("fell")))
        best, border = merged.select("node", "cost"), merged.where("fell").select("node", "cost")
    return best


def summary(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes, edges, components, and means and greatest of degrees: one row."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    degrees = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    stats = degrees.agg(F.count("*").alias("nodes"), F.sum("o").alias("edges"), F.max("o").alias("most_out"), F.max("i").alias("most_in"), F.round(F.avg(F.col("o") + F.col("i")), 6).alias("mean_degree"))
    return stats.crossJoin(F.broadcast(components.agg(F.count_distinct("component").alias("components"))))

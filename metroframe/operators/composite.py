"""Paths over several kinds of relation at once: calls, shared devices and common counterparts.

A search goes level by level from a source. Only the border's nodes meet the tables, so a step costs what they touch; from each
node the strongest partners of each relation are followed, by a window. Nothing is gathered but the border, whose size has a bound."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: The weight of each relation, in the order in which relations are tried.
WEIGHTS = {"call": 5.0, "shared_device": 4.0, "common_counterparty": 2.0}
#: Fixed value: what each step takes from a path's score.
STEP_COST = 0.3


@dataclass(frozen=True)
class Relations:
    """calls (src, dst), one row a call; devices (member, device). directed: a call is a relation from src to dst alone.
    each: partners that are followed for a relation and node. common: counterparts that two nodes share at least."""

    calls: DataFrame
    devices: DataFrame
    directed: bool = True
    each: int = 20
    common: int = 2

    def partners(self, nodes: DataFrame) -> DataFrame:
        """(node, other, relation, order, evidence, sample) of nodes (column node), all of each relation."""
        out = self.calls.select(F.col("src").alias("node"), F.col("dst").alias("other"))
        if not self.directed:
            out = out.union(self.calls.select("dst", "src"))
        asked = F.broadcast(nodes)  # a border, of bounded size
        none = F.lit(None).cast("string")
        call = out.where("other IS NOT NULL").join(asked, "node").groupBy("node", "other").agg(F.count("*").alias("evidence")).withColumn("sample", none)
        found = [call]
        for one, item, least in ((self.devices.select(F.col("member").alias("other"), F.col("device").alias("item")), "device", 1), (self.calls.select(F.col("src").alias("other"), F.col("dst").alias("item")), "dst", self.common)):
            one = one.where("other IS NOT NULL AND item IS NOT NULL").distinct()
            mine = one.join(asked.withColumnRenamed("node", "other"), "other").withColumnRenamed("other", "node")
            met = mine.join(one, "item").where("node != other").groupBy("node", "other").agg(F.count("*").alias("evidence"), F.min("item").cast("string").alias("sample"))
            found.append(met.where(F.col("evidence") >= least))
        named = [f.select("node", "other", F.lit(r).alias("relation"), F.lit(i).alias("order"), "evidence", "sample") for i, (r, f) in enumerate(zip(WEIGHTS, found))]
        return named[0].unionByName(named[1]).unionByName(named[2])

    def steps(self, nodes: DataFrame) -> DataFrame:
        """(node, other, relation, evidence, sample, worth, place): the best relation to each partner among the first of each relation, in order of place."""
        by = Window.partitionBy("node", "relation").orderBy(F.desc("evidence"), "other")
        first = self.partners(nodes).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= self.each)
        weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
        worth = weight[F.col("relation")] * F.log1p(F.greatest("evidence", F.lit(1)).cast("double"))
        best = F.max(F.struct(worth.alias("worth"), (-F.col("order")).alias("order"), "relation", "evidence", "sample")).alias("best")
        place = F.min(F.col("order") * 1_000_000 + F.col("rank")).alias("place")
        return first.groupBy("node", "other").agg(best, place).select("node", "other", "best.relation", "best.evidence", "best.sample", "best.worth", "place")


def _ranked(paths: DataFrame, strategy: str, top: int) -> DataFrame:
    """The first paths: the shortest, or those of the highest score; ties in the order in which they were found."""
    score = F.round(F.aggregate("worths", F.lit(0.0), lambda s, x: s + x) - STEP_COST * F.size("worths"), 6)
    rows = paths.select("path", "relations", "evidence", F.size("worths").alias("hops"), score.alias("score"), "places")
    by: list[Column] = [F.col("hops"), F.desc("score")] if strategy == "shortest" else [F.desc("score"), F.col("hops")]
    return rows.orderBy(*by, "places").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*by, "places"))).drop("places")


def _longer(border: DataFrame, steps: DataFrame) -> DataFrame:
    """The border's paths with one step more, to nodes that they don't have yet."""
    step = steps.select("node", "other", "relation", "sample", "worth", "place")
    more = border.join(step, "node").where(~F.array_contains("path", F.col("other")))
    add = lambda column, value: F.concat(column, F.array(value)).alias(column)
    return more.select(F.col("other").alias("node"), add("path", "other"), add("relations", "relation"), add("evidence", "sample"), add("worths", "worth"), add("places", "place"))


def find(relations: Relations, source, target, hops: int = 3, expansions: int = 500, strategy: str = "balanced", top: int = 10) -> tuple[DataFrame, dict]:
    """Paths (rank, path, relations, evidence, hops, score) from source to target, and what the search did: {"direct", "searched", "truncated"}.

    If the two are directly related, whatever the relation, those relations are the answer and nothing is searched. Else paths of at
    most so many hops that repeat no node; a node that was reached on an earlier level isn't entered again, and at most so many
    paths are followed on, in the order in which they were found (truncated says whether some were not). strategy: shortest,
    strongest or balanced (as strongest). evidence holds a shared device or counterpart for each step, null for calls.
    """
    if strategy not in ("shortest", "strongest", "balanced"):
        raise ValueError("a strategy is shortest, strongest or balanced")
    spark = relations.calls.sparkSession
    one = spark.createDataFrame([(source,)], "node long")
    empty = "path array<long>, relations array<string>, evidence array<string>, worths array<double>, places array<long>"
    if source == target:
        return _ranked(spark.createDataFrame([([source], [], [], [], [])], empty), strategy, top), {"direct": True, "searched": 1, "truncated": False}
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    direct = relations.partners(one).where(F.col("other") == target)
    direct = direct.select(
        F.array(F.lit(source), F.lit(target)).cast("array<long>").alias("path"), F.array("relation").alias("relations"), F.array("sample").alias("evidence"),
        F.array(weight[F.col("relation")] * F.log1p(F.col("evidence").cast("double"))).alias("worths"), F.array(F.col("order").cast("long")).alias("places"),
    )
    direct = cut(spark, direct)
    if not direct.isEmpty():
        return _ranked(direct, strategy, top), {"direct": True, "searched": 1, "truncated": False}
    border = spark.createDataFrame([(source, [source], [], [], [], [])], f"node long, {empty}")
    reached, found = one, spark.createDataFrame([], empty)
    searched, truncated = 0, False
    for _ in range(hops):
        n = border.count()
        if searched + n > expansions:
            border, truncated = border.orderBy("places").limit(expansions - searched), True
        searched += min(n, expansions - searched)
        longer = _longer(border, relations.steps(border.select("node").distinct()))
        longer = cut(spark, longer)
        found = found.unionByName(longer.where(F.col("node") == target).drop("node"))
        border = longer.where(F.col("node") != target).join(reached, "node", "left_anti")
        border = border.select("node", "path", "relations", "evidence", "worths", "places")
        reached = reached.union(border.select("node").distinct())
        if truncated or border.isEmpty():
            break
    return _ranked(found, strategy, top), {"direct": False, "searched": searched, "truncated": truncated}

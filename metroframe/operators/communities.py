"""Communities of a graph by modularity: Louvain's local moves and contractions as joins and groupings.

Each step looks at every node's weight towards the communities of its neighbours, is written, and the step before it is deleted, so a
lost executor costs one step and disk holds two. Where nodes are whole numbers, links are packed once for each level, by blocks of nodes, and
a step sends all nodes' communities, packed, to each block, so no step has a row for each link; other nodes' links meet their communities in joins. Many nodes move at once, so moves can undo each
other. First a half of the nodes that want to move, drawn anew from a seed at each step, does; a step that doesn't raise modularity
is taken back. Then only moves that share no community are made: their gains add up exactly, so modularity rises until no node
gains by moving, or by less than a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, forget
from . import blocks

#: A move gains more than this, in units of weight.
LEAST_GAIN = 1e-9
#: Links of a block of nodes, from either end, and nodes whose communities are unpacked at once; with fewer links than FEW a level is looked at by joins, which begin sooner.
BLOCK, NODES, FEW = 3_000_000, 1_000_000, 1_000_000


def undirected_links(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(u, v, w), u < v: a row for each pair that edges (src, dst) link, whichever way. Weights are summed; without a weight each pair weighs 1.

    Loops, edges with a null end, and weights that are null or not above 0 are left out."""
    valid = edges.where("src != dst") if weight is None else edges.where(f"src != dst AND {weight} > 0")
    w = F.lit(1.0) if weight is None else F.sum(F.col(weight).cast("double"))
    return valid.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(w.alias("w"))


def modularity(links: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity, communities, nodes) of a partition (node, community) of links (u, v, w).

    The share of weight inside communities, less the share that is expected by the degrees of their nodes. Nodes without a community are one
    each; without links modularity is 0."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other"), "w"), F.struct(F.col("v").alias("node"), F.col("u").alias("other"), "w"))).alias("e")).select("e.*")
    named = lambda c: members.select(F.col("node").alias(c), F.col("community").alias(f"{c}_in"))
    own = lambda c: F.struct(F.coalesce(F.col(f"{c}_in"), F.col(c)).alias("c"), F.col(f"{c}_in").isNull().alias("alone"))
    rows = ends.join(named("node"), "node", "left").join(named("other"), "other", "left").select("node", "w", own("node").alias("c"), (own("node") == own("other")).alias("same"))
    per = rows.groupBy("c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("inside"), F.count_distinct("node").alias("n"))
    total = F.sum("k")
    return per.agg(
        F.coalesce(F.try_divide(F.sum("inside"), total) - resolution * F.try_divide(F.sum(F.col("k") * F.col("k")), total * total), F.lit(0.0)).alias("modularity"),
        F.count("*").alias("communities"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"),
    )


class Packed:
    """A level's links (u, v, w), from both ends: as packed rows (block, part, rows) by the block of u and the part of v. n_blocks and n_parts are numbers of these; state is the level's first, n the number of links."""

    def __init__(self, both: DataFrame, state: DataFrame, n: int):
        self.n_blocks = max(-(-n // BLOCK), min(blocks.LEAST_BLOCKS, -(-n // blocks.FEW)))
        self.n_parts = max(1, -(-state.count() // NODES))
        at = self.of("u", self.n_blocks) * self.n_parts + self.of("v", self.n_parts)
        made = both.select(at.alias("block"), "u", "v", "w").mapInArrow(blocks.pack(["v"]), "block int, rows binary")
        self.rows = cut(both.sparkSession, made.select(F.floor(F.col("block") / self.n_parts).cast("int").alias("block"), (F.col("block") % self.n_parts).alias("part"), "rows"))

    @staticmethod
    def of(node: str, n: int):
        return F.pmod(F.xxhash64(node), F.lit(n)).cast("int")


def _opened(parts: list) -> dict[str, np.ndarray]:
    """Packed rows as columns, in order of nodes if they are nodes."""
    table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts])
    table = table.sort_by("node") if "node" in table.column_names else table
    return {c: table[c].to_numpy() for c in table.column_names}


def _moves(total: float, resolution: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the nodes of a block look at: its links and nodes, and all nodes part by part."""
        links, nodes, own = {}, {}, []
        for batch in batches:
            for kind, part, rows in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist(), batch.column("rows")):
                (own if kind == 2 else (links, nodes)[kind].setdefault(part, [])).append(rows.as_buffer())
        if not own:
            return
        mine = _opened(own)
        n = len(mine["node"])
        u, cv, w, sums = [np.arange(n)], [mine["c"]], [np.zeros(n)], [mine["sum"]]
        for part in sorted(links):
            e, there = _opened(links.pop(part)), _opened(nodes.pop(part))
            at = np.searchsorted(there["node"], e["v"])
            for x, y in ((u, np.searchsorted(mine["node"], e["u"])), (cv, there["c"][at]), (w, e["w"]), (sums, there["sum"][at])):
                x.append(y)
        u, cv, w, sums = (np.concatenate(x) for x in (u, cv, w, sums))
        low, span = int(cv.min()), int(cv.max()) - int(cv.min()) + 1
        order = np.argsort(u * span + (cv - low)) if span * n < 2**62 else np.lexsort((cv, u))
        u, cv = u[order], cv[order]
        first = np.ones(len(u), bool)
        first[1:] = (u[1:] != u[:-1]) | (cv[1:] != cv[:-1])
        starts = np.flatnonzero(first)
        w, sums = np.add.reduceat(w[order], starts), sums[order[starts]]
        u, cv = u[starts], cv[starts]
        stays, k = cv == mine["c"][u], mine["k"][u]
        worth = w - resolution * k * (sums - np.where(stays, k, 0.0)) / total
        of = np.searchsorted(u, np.arange(n))  # each has its own community at least
        most = np.maximum.reduceat(worth, of)
        to = cv[np.maximum.reduceat(np.where(worth == most[u], np.arange(len(u)), -1), of)]
        gain = most - worth[stays]
        none = ~(gain > LEAST_GAIN)
        columns = [mine["node"], mine["k"], mine["loop"], mine["c"], w[stays]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(to, mask=none), pa.array(gain, mask=none)], ["node", "k", "loop", "c", "inside", "to", "gain"])

    return run


def _look(state: DataFrame, both: DataFrame | Packed, total: float, resolution: float) -> DataFrame:
    """state (node, k, loop, c) with what each node has inside its community, where it would rather be, and what it gains (node, k, loop, c, inside, to, gain)."""
    if not isinstance(both, Packed):
        return _look_by_joins(state, both, total, resolution)
    sums = state.groupBy("c").agg(F.sum("k").alias("sum"))
    at = F.explode(F.array(both.of("node", both.n_blocks), F.lit(both.n_blocks) + both.of("node", both.n_parts)))
    packed = state.join(sums, "c").select(at.alias("block"), "node", "k", "loop", "c", "sum").mapInArrow(blocks.pack(["node"]), "block int, rows binary")
    own = F.col("block") < both.n_blocks
    to = F.when(own, F.array("block")).otherwise(F.sequence(F.lit(0), F.lit(both.n_blocks - 1)))
    sent = packed.select(F.explode(to).alias("to"), F.when(own, 2).otherwise(1).alias("kind"), (F.col("block") - both.n_blocks).alias("part"), "rows")
    rows = both.rows.select(F.col("block").alias("to"), F.lit(0).alias("kind"), "part", "rows").union(sent)
    return rows.repartition(both.n_blocks, "to").groupBy("to").applyInArrow(_moves(total, resolution), "node long, k double, loop double, c long, inside double, to long, gain double")


def _look_by_joins(state: DataFrame, both: DataFrame, total: float, resolution: float) -> DataFrame:
    """The same from rows of links."""
    there = both.join(state.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").select("u", "cv", "w")
    own = state.select(F.col("node").alias("u"), F.col("c").alias("cv"), F.lit(0.0).alias("w"))
    towards = there.unionByName(own).groupBy("u", "cv").agg(F.sum("w").alias("w"))
    sums = state.groupBy(F.col("c").alias("cv")).agg(F.sum("k").alias("sum"))
    seen = towards.join(sums, "cv").join(state, F.col("u") == F.col("node"))
    stays = F.col("cv") == F.col("c")
    worth = F.col("w") - resolution * F.col("k") * (F.col("sum") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    best = F.max(F.struct(worth.alias("worth"), stays.alias("stays"), F.col("cv").alias("to"))).alias("best")
    found = seen.groupBy("node", "k", "loop", "c").agg(best, F.max(F.when(stays, F.col("w"))).alias("inside"), F.max(F.when(stays, worth)).alias("worth"))
    gain = F.col("best.worth") - F.col("worth")
    return found.select("node", "k", "loop", "c", "inside", F.when(gain > LEAST_GAIN, F.col("best.to")).alias("to"), F.when(gain > LEAST_GAIN, gain).alias("gain"))


def _value(looked: DataFrame, total: float, resolution: float) -> tuple[float, int]:
    """The modularity of the state that was looked at, and how many nodes would rather be elsewhere."""
    per = looked.groupBy("c").agg(F.sum("k").alias("k"), F.sum(F.col("inside") + F.col("loop")).alias("inside"), F.count("to").alias("movers"))
    inside, expected, movers = per.agg(F.sum("inside"), F.sum(F.col("k") * F.col("k")), F.sum("movers")).first()
    return inside / total - resolution * expected / total / total, movers


def _apart(looked: DataFrame) -> DataFrame:
    """Of the moves, those that are the best of all that touch their old or their new community."""
    moves = looked.where("to IS NOT NULL").select("node", "c", "to", F.struct("gain", F.xxhash64("node").alias("h"), "node").alias("claim"))
    best = moves.select(F.explode(F.array("c", "to")).alias("at"), "claim").groupBy("at").agg(F.max("claim").alias("most"))
    left = moves.join(best.select(F.col("at").alias("c"), F.col("most").alias("one")), "c").join(best.select(F.col("at").alias("to"), F.col("most").alias("two")), "to")
    return left.where("claim = one AND claim = two").select("node", "to")


def _settle(state: DataFrame, both: DataFrame | Packed, total: float, resolution: float, seed: int, steps: int, tolerance: float) -> tuple[DataFrame, float]:
    """The nodes as they were looked at last, with their communities, and the modularity; state is deleted."""
    spark = state.sparkSession
    kept = cut(spark, _look(state, both, total, resolution))
    forget(state)
    value, movers = _value(kept, total, resolution)
    failed = 0
    for step in range(steps):
        if not movers:
            break
        if failed < 2:
            goes = (F.pmod(F.xxhash64("node", F.lit(step), F.lit(seed)), F.lit(2)) == 0) & F.col("to").isNotNull()
            looked = cut(spark, _look(kept.select("node", "k", "loop", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c")), both, total, resolution))
        else:
            goes = _apart(kept).withColumnRenamed("to", "goes")
            moved = cut(spark, kept.join(goes, "node", "left").select("node", "k", "loop", F.coalesce("goes", "c").alias("c")))
            looked = cut(spark, _look(moved, both, total, resolution))
            forget(moved)
        new, then = _value(looked, total, resolution)
        if new > value + tolerance:
            forget(kept)
            kept, value, movers = looked, new, then
        else:
            forget(looked)
            failed += 1
            if failed > 2:
                break
    return kept, value


def louvain(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, seed: int = 0, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """(node, community): a partition of the nodes of edges (src, dst) of high modularity; a community is named by its least node.

    Links are as in undirected_links. A greater resolution makes smaller communities. The same edges and seed give the same communities as
    long as sums of weights are exact (whole weights are). steps bounds the steps of a level, which on large graphs end by tolerance.
    A level's communities are the next one's nodes, until modularity rises by less than tolerance. Without edges there are no rows."""
    spark = edges.sparkSession
    links = cut(spark, undirected_links(edges, weight))
    total = 2.0 * (links.agg(F.sum("w")).first()[0] or 0.0)
    both = cut(spark, links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    forget(links)
    state = cut(spark, both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).select("node", "k", F.lit(0.0).alias("loop"), F.col("node").alias("c")))
    members = cut(spark, state.select("node", F.col("node").alias("community")))
    value = None
    while total:
        n = both.count() if both.schema["u"].dataType.typeName() == "long" else 0
        packed = Packed(both, state, n) if n >= FEW else None
        settled, new = _settle(state, packed or both, total, resolution, seed, steps, tolerance)
        if packed:
            forget(packed.rows)
        if value is not None and new <= value + tolerance:
            break
        value = new
        before, members = members, cut(spark, members.join(settled.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        named = settled.select("node", "c")
        u, v = named.toDF("u", "cu"), named.toDF("v", "cv")
        joined = both.join(u, "u").join(v, "v").where("cu != cv").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        after = cut(spark, joined)
        state = cut(spark, settled.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k"), F.sum(F.col("inside") + F.col("loop")).alias("loop")).select("node", "k", "loop", F.col("node").alias("c")))
        forget(before, both, settled)
        both = after
    names = members.groupBy("community").agg(F.min("node").alias("name"))
    return members.join(names, "community").select("node", F.col("name").alias("community"))


def statistics(links: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each community: nodes, links inside it and to others, and the density of those inside."""
    u, v = members.toDF("u", "cu"), members.toDF("v", "cv")
    ends = links.join(u, "u").join(v, "v").select(F.explode(F.when(F.col("cu") == F.col("cv"), F.array(F.struct(F.col("cu").alias("community"), F.lit(1).alias("i"), F.lit(0).alias("o")))).otherwise(
        F.array(F.struct(F.col("cu").alias("community"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("cv").alias("community"), F.lit(0).alias("i"), F.lit(1).alias("o"))))).alias("e")).select("e.*")
    counts = ends.groupBy("community").agg(F.sum("i").alias("inside"), F.sum("o").alias("outside"))
    sizes = members.groupBy("community").agg(F.count("*").alias("nodes"))
    inside = F.coalesce("inside", F.lit(0))
    pairs = F.col("nodes") * (F.col("nodes") - 1) / 2
    return sizes.join(counts, "community", "left").select("community", "nodes", inside.alias("inside"), F.coalesce("outside", F.lit(0)).alias("outside"), F.round(F.coalesce(F.try_divide(inside, pairs), F.lit(0.0)), 6).alias("density"))

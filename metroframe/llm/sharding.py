"""Minimax contiguous partition of documents into shards.

The atomic groups (documents of equal text; null counts as empty) stand in the order of their least doc_id. The smallest
capacity at which a greedy pass needs no more shards than there are is found by binary search, and the order is cut there.

The groups never come to the driver. Their running sums are kept as a table, of which the driver sees cells: runs of
neighbouring groups with their first and last position, at most CELLS at a time. A greedy pass that may cut anywhere in a
cell bounds the capacity from below, one that may cut between cells only bounds it from above; the cells in which a cut can
lie between the two are split until these are single groups, so that the result is exact at any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parallelism, running_offsets

CELLS = 1 << 16
SPLIT = 64
OVERHEAD = 16


def _jump(starts, ends, fuzzy, pos: int, capacity: int, relaxed: bool) -> int:
    limit = pos + capacity
    if limit >= ends[-1]:
        return int(ends[-1])
    k = int(np.searchsorted(starts, limit, "right")) - 1
    return limit if relaxed and fuzzy[k] and limit < ends[k] else int(starts[k])


def _cuts(starts, ends, fuzzy, shards: int, capacity: int, relaxed: bool) -> list[int] | None:
    """Where the shards end by a greedy pass; None if they are too few."""
    pos, out = 0, []
    while pos < ends[-1]:
        to = _jump(starts, ends, fuzzy, pos, capacity, relaxed)
        if to <= pos or len(out) == shards:
            return None
        out.append(pos := to)
    return out


def _least(starts, ends, fuzzy, shards: int, relaxed: bool) -> int:
    low, high = -(-int(ends[-1]) // shards), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if _cuts(starts, ends, fuzzy, shards, mid, relaxed) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _balanced(starts, ends, shards: int, capacity: int) -> list[int] | None:
    """Cuts at the group nearest an equal share of what is left, where all shards stay within the capacity."""
    edges, pos, out = np.append(starts, ends[-1]), 0, []
    for left in range(shards, 0, -1):
        if pos == ends[-1]:
            break
        ideal = pos + (ends[-1] - pos) / left
        k = int(np.searchsorted(edges, ideal))
        near = [int(e) for e in edges[max(k - 1, 0) : k + 1] if pos < e <= pos + capacity]
        if not near:
            return None
        out.append(pos := min(near, key=lambda e: abs(e - ideal)))
    return out if pos == ends[-1] else None


def _cells(groups: DataFrame, lows: np.ndarray, highs: np.ndarray, parts: int) -> list:
    """Of the groups that start in one of the ranges, each range dealt into parts: first and last start, last position, number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            start, size = batch["start"].to_numpy(), batch["size"].to_numpy()
            k = np.searchsorted(lows, start, "right") - 1
            keep = start < highs[k]
            start, size, k = start[keep], size[keep], k[keep]
            if len(start):
                cell = k * parts + (start - lows[k]) * parts // (highs[k] - lows[k])
                order = np.lexsort((start, cell))
                begins = np.flatnonzero(np.diff(cell[order], prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[order][begins]), pa.array(start[order][begins]), pa.array(start[order][np.append(begins[1:], len(order)) - 1]), pa.array(np.maximum.reduceat((start + size)[order], begins)), pa.array(np.diff(begins, append=len(order)))],
                    names=["cell", "start", "last", "end", "n"],
                )

    made = groups.select("start", "size").mapInArrow(run, "cell long, start long, last long, end long, n long")
    return made.groupBy("cell").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.max("end").alias("end"), F.sum("n").alias("n")).collect()


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """groups: (start, size), sizes above 0, starts their running sums. Where each shard but the last ends, at most shards - 1."""
    total = groups.agg(F.max(F.col("start") + F.col("size"))).first()[0]
    if not total:
        return []
    known: dict[int, tuple[int, bool, int]] = {}  # first position: last position, several groups, where the last of them starts
    lows, highs, parts = np.array([0]), np.array([total]), CELLS
    while True:
        known.update((r["start"], (r["end"], r["n"] > 1, r["last"])) for r in _cells(groups, lows, highs, parts))
        starts = np.array(sorted(known), dtype=np.int64)
        ends = np.array([known[s][0] for s in starts.tolist()], dtype=np.int64)
        fuzzy = np.array([known[s][1] for s in starts.tolist()])
        low, high = (_least(starts, ends, fuzzy, shards, relaxed) for relaxed in (True, False))
        if low == high:
            return (_balanced(starts, ends, shards, high) or _cuts(starts, ends, fuzzy, shards, high, False))[:-1]
        early = late = 0
        split: set[int] = set()
        for _ in range(shards):
            early = max(early, _jump(starts, ends, fuzzy, early, low, False))
            late = _jump(starts, ends, fuzzy, late, high, True)
            a, b = np.searchsorted(starts, [early, late], "right") - 1
            split.update(int(i) for i in range(a, b + 1) if fuzzy[i])
        at = sorted(split)
        lows, parts = starts[at], SPLIT
        highs = np.array([known[s][2] + 1 for s in lows.tolist()], dtype=np.int64)  # so that the first and the last part company
        for s in lows.tolist():
            del known[s]


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, shard and slot: the row's place in its shard, by doc_id.

    A text's size is its bytes in UTF-8 and OVERHEAD. Null texts have no bytes and stand with the empty ones. Null ids come
    first; repeated rows have a slot each. An empty table gives no rows; with fewer groups than shards, the last stay empty.
    """
    n = parallelism(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    base = cut(docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")), "sharding-rows")
    groups = base.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("size"))

    def sums(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch["size"].to_numpy()
            ends = total + np.cumsum(size)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int32)), batch["key"], batch["size"], pa.array(ends - size)], names=["part", "key", "size", "local"])

    ordered = groups.repartitionByRange(n, "first", "key").sortWithinPartitions("first", "key")
    summed = cut(ordered.mapInArrow(sums, "part int, key binary, size long, local long"), "sharding-groups")
    offsets = running_offsets(summed.groupBy("part").agg(F.sum("size").alias("size")), "part", "size", "offset")
    placed = summed.join(F.broadcast(offsets), "part").select("key", "size", (F.col("local") + F.col("offset")).alias("start"))
    cuts = minimax_cuts(placed, shards)
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("start") >= c).cast("int")
    dealt = cut(base.join(placed.select("key", number.alias("shard")), "key").drop("key"), "sharding-dealt")

    def ranks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            shard = batch["shard"].to_numpy()
            begins = np.flatnonzero(np.diff(shard, prepend=-1))
            rank = np.arange(len(shard)) - np.repeat(begins, np.diff(begins, append=len(shard)))
            if len(shard):
                rank[shard == last] += seen
                last, seen = int(shard[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(np.full(len(shard), part, np.int32)), pa.array(rank)], names=["doc_id", "size", "text_crc32", "shard", "part", "rank"])

    by_range = ["shard", "doc_id", "text_crc32"]
    ranked = cut(dealt.repartitionByRange(n, *by_range).sortWithinPartitions(*by_range).mapInArrow(ranks, "doc_id long, size long, text_crc32 long, shard int, part int, rank long"), "sharding-ranks")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("shard", "part").agg(F.count("*").alias("rows"))  # at most partitions + shards rows
    counts = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    return ranked.join(F.broadcast(counts), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("rank") + F.col("earlier")).alias("slot"))

"""Pairs of a group's members that have devices, calls or counterparts in common: how many there are, and which members hang together, without a row for any pair.

Members are dealt into blocks (see blocks.py), and where two blocks meet, the pairs between a few members of one and all of the other are made and counted at a time.
Of what they link, a row for each member at most is left: the first member that it hangs together with there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks

#: Rows of a block; pairs made at once (of one member more, if it makes more with a block); and what a row says: that u has a device, or a counterpart, or called or was called by another member.
BLOCK, AT_ONCE = 2_000_000, 2_000_000
DEVICE, COUNTERPART, CALL = 0, 1, 2


def joined(f: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """f, the least place that each place hangs together with (f[f] is f), once u and v do as well."""
    while True:
        a, b = f[u], f[v]
        apart = a != b
        if not apart.any():
            return f
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(f, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(g := f[f], f):
            f = g


def _meet(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], first: np.ndarray, counts: np.ndarray, where: np.ndarray, n: int, same: bool) -> np.ndarray:
    """For the rows where of one (u, item), a key u * n + v for each row of two (v, item) with the same item, from first on; same: only where u < v. In order."""
    i, j = blocks.spread(counts[where], first[where])
    u, v = one[0][where][i], two[0][j]
    if same:
        kept = u < v
        u, v = u[kept], v[kept]
    keys = u * n + v
    keys.sort()
    return keys


def _different(keys: np.ndarray, times: int = 1) -> np.ndarray:
    """Of keys in order, each that is there so many times."""
    if len(keys) < times:
        return keys[:0]
    last = np.ones(len(keys), bool)
    last[:-1] = keys[1:] != keys[:-1]
    if times > 1:
        last[times - 1 :] &= keys[times - 1 :] == keys[: len(keys) - times + 1]
        last[: times - 1] = False
    return keys[last]


def _group(least: int):
    def run(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        both, ends = pa.concat_tables(tables), np.cumsum([0, *map(len, tables)]).tolist()
        same = len(tables) == 1
        (users, u), (_, item), kind = blocks.ranked(both["u"]), blocks.ranked(both["item"]), both["kind"].to_numpy()
        n = len(users)
        one_of = np.zeros(n, bool)
        one_of[u[: ends[1]]] = True
        other = pc.index_in(both["item"], pc.cast(users, both["item"].type)).combine_chunks().fill_null(-1).to_numpy().astype(np.int64)
        del both

        def side(k: int, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
            """Different rows (u, item) of a kind, in order of item."""
            mine = kind[at:to] == k
            keys = np.unique(item[at:to][mine] * n + u[at:to][mine])
            return keys % n, keys // n

        f, shared = np.arange(n), {}
        for k in (DEVICE, COUNTERPART):
            one, two = side(k, 0, ends[1]), side(k, ends[-2], ends[-1])
            first = np.searchsorted(two[1], one[1], "left")
            shared[k] = one, two, first, np.searchsorted(two[1], one[1], "right") - first
            if k == DEVICE:  # all with a device hang together, by way of the first of them
                all_u, all_items = (one if same else tuple(np.concatenate(x) for x in zip(one, two)))
                order = np.lexsort((all_u, all_items))
                all_u, all_items = all_u[order], all_items[order]
                start = np.ones(len(all_u), bool)
                start[1:] = all_items[1:] != all_items[:-1]
                f = joined(f, all_u, all_u[np.flatnonzero(start)[np.cumsum(start) - 1]]) if len(all_u) else f
        calls = (kind[: ends[1]] == CALL) & (other[: ends[1]] >= 0)
        x, y = u[: ends[1]][calls], other[: ends[1]][calls]
        kept = (x < y) if same else ~one_of[y]
        called = np.unique(x[kept] * n + y[kept])
        weight = sum(np.bincount(one[0], counts, n) for one, _, _, counts in shared.values()) + np.bincount(called // n, minlength=n)
        part = (np.cumsum(weight) // AT_ONCE).astype(np.int64)
        totals = np.zeros(3, np.int64)
        for p in np.unique(part[one_of]):
            by = {k: _meet(one, two, first, counts, part[one[0]] == p, n, same) for k, (one, two, first, counts) in shared.items()}
            devices, counterparts, direct = _different(by[DEVICE]), _different(by[COUNTERPART], least), called[part[called // n] == p]
            linked = np.concatenate([counterparts, direct])
            f = joined(f, linked // n, linked % n)
            totals += len(np.unique(np.concatenate([devices, linked]))), len(direct), len(devices)
        yield pa.RecordBatch.from_arrays([pa.array([int(t)], pa.int64()) for t in totals] + [pa.nulls(1, users.type)] * 2, ["pairs", "calling_pairs", "device_pairs", "node", "first"])
        moved = np.flatnonzero(f != np.arange(n))
        if len(moved):
            none = pa.array(np.zeros(len(moved), np.int64))
            yield pa.RecordBatch.from_arrays([none, none, none, users.take(pa.array(moved)), users.take(pa.array(f[moved]))], ["pairs", "calling_pairs", "device_pairs", "node", "first"])

    return run


def counted(own: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Of the calls that members made, rows (pairs, calling_pairs, device_pairs, node, first), for sums and links: numbers of pairs of members, as relation_matrix has them
    (with a device, a call or max(2, least) counterparts in common), with no node; and members (node) with another that each hangs together with (first), with no pairs."""
    ids = own.schema["src"].dataType
    inside = own.where("src != dst").join(members.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    kinds = {own.schema[c].dataType for c in ("src", "device", "dst")}
    value = lambda c: F.col(c) if len(kinds) == 1 else F.col(c).cast("string")
    row = lambda k, u, item: F.struct(F.lit(k).alias("kind"), F.col(u).alias("u"), value(item).alias("item"))
    shared = own.select(F.explode(F.array(row(DEVICE, "src", "device"), row(COUNTERPART, "src", "dst"))).alias("r"))
    direct = inside.select(F.explode(F.array(row(CALL, "src", "dst"), row(CALL, "dst", "src"))).alias("r"))
    rows = shared.union(direct).select("r.*").where(F.col("u").isNotNull() & F.col("item").isNotNull())
    out = T.StructType([*T._parse_datatype_string("pairs long, calling_pairs long, device_pairs long").fields, T.StructField("node", ids), T.StructField("first", ids)])
    return blocks.apply(rows, "u", ["kind", "u", "item"], BLOCK, _group(max(2, least)), out)

"""Numbers of tied pairs and what hangs together, against plain loops over all pairs of members."""

import random
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from test_graph import components

from metroframe.operators import blocks, ties


def made(n, members, seed):
    """(src, device, dst) of members, who are even numbers; some devices and counterparts are shared, some subjects are called that aren't members, or never call."""
    chance = random.Random(seed)
    return [(2 * chance.randrange(members), chance.choice([None, chance.randrange(10**6), chance.randrange(40)]), chance.choice([None, chance.randrange(2 * members), 10**7 + chance.randrange(60)])) for _ in range(n)]


def plain(rows, members):
    has = [defaultdict(set), defaultdict(set)]
    for u, device, dst in rows:
        has[0][u].add(device)
        has[1][u].add(dst)
    devices = {p for p in combinations(members, 2) if (has[0][p[0]] & has[0][p[1]]) - {None}}
    common = {p for p in combinations(members, 2) if len((has[1][p[0]] & has[1][p[1]]) - {None}) >= 2}
    direct = {(min(u, v), max(u, v)) for u, _, v in rows if u != v and v in set(members)}
    return (len(devices | common | direct), len(direct), len(devices)), components(devices | common | direct)


def found(rows):
    links = [(r["node"], r["first"]) for r in rows if r["node"] is not None]
    return tuple(sum(r[c] for r in rows) for c in ("pairs", "calling_pairs", "device_pairs")), components(links)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_counted(spark, monkeypatch, kind):
    """Over several blocks; no pair gets a row, so rows are as many as blocks' members at most."""
    monkeypatch.setattr(ties, "BLOCK", 150)
    rows, members = made(400, 90, 1), list(range(0, 180, 2))
    own = spark.createDataFrame(rows, "src long, device long, dst long").selectExpr("src", f"CAST(device AS {kind}) AS device", "dst")
    got = ties.counted(own, spark.createDataFrame([(m,) for m in members], "id long")).collect()
    want = plain(rows, members)
    assert found(got) == want and want[0][0] > want[0][2] > want[0][1] > 0
    assert ties.counted(own.limit(0), spark.range(0)).collect() == []


@pytest.mark.parametrize("at_once", [1, 40, 10**6])
def test_parts_of_a_group(monkeypatch, at_once):
    """The same numbers, however few pairs are made at once; rows are fewer than pairs."""
    monkeypatch.setattr(ties, "AT_ONCE", at_once)
    rows, members = made(500, 60, 2), list(range(0, 120, 2))
    each = [(k, u, v) for u, device, dst in rows for k, v in ((ties.DEVICE, device), (ties.COUNTERPART, dst)) if v is not None]
    each += [(ties.CALL, *e) for u, _, dst in rows if dst in set(members) and u != dst for e in ((u, dst), (dst, u))]
    table = pa.Table.from_pylist([{"block": u // 2 % 2, "kind": k, "u": u, "item": v} for k, u, v in each])
    packed = pa.Table.from_batches(blocks.pack(["kind", "u", "item"])(iter(table.to_batches(max_chunksize=90)))).to_pylist()
    got = []
    for i, j in ((0, 0), (0, 1), (1, 1)):
        group = [pa.RecordBatch.from_pylist([{"i": i, "j": j, **r}]) for r in packed if r["block"] in (i, j)]
        got += [r for batch in ties._group(2)(blocks.unpack(iter(group))) for r in batch.to_pylist()]
    assert found(got) == plain(rows, members)
    assert len(got) < 2 * len(members) + 3 < plain(rows, members)[0][0]

"""Meetings against a plain loop over all pairs of visits."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from itertools import combinations

import pyarrow as pa
import pytest

from metroframe.operators import blocks, meetings

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made(n, users, cells, seed, name=int):
    chance = random.Random(seed)
    rows = [(name(chance.randrange(users)), f"c{chance.randrange(cells)}", s := chance.randrange(0, 86400, 60), s + chance.randrange(60, 9000, 60) + chance.choice([0, 0.25])) for _ in range(n)]
    return rows + rows[:20] + [(name(0), "c1", 10, 5), (name(1), "c1", 50, 50)]


def plain(rows, least=15):
    found = defaultdict(list)
    for (u, c, s, e), (v, d, t, f) in combinations(rows, 2):
        lasts = min(e, f) - max(s, t)
        if u != v and c == d and lasts >= least * 60:
            found[min(u, v), max(u, v)].append((round(lasts / 60 + 1e-9, 2), c))
    return {k: (len(x), pytest.approx(sum(m for m, _ in x)), ",".join(sorted({c for _, c in x}))) for k, x in found.items()}


@pytest.mark.parametrize("name, kind", [(int, "long"), ("u{}".format, "string")])
def test_meetings(spark, monkeypatch, name, kind):
    """Over several blocks of users, each pair is found once; no join or grouping of meetings is planned, so none is shuffled."""
    monkeypatch.setattr(meetings, "BLOCK", 100)
    rows = made(400, 40, 11, 3, name)
    at = lambda s: START + timedelta(seconds=s)
    df = spark.createDataFrame([(u, c, at(s), at(e)) for u, c, s, e in rows] + [(None, "c1", at(0), at(9e4)), (name(1), None, at(0), at(9e4)), (name(1), "c1", None, at(9e4)), (name(1), "c1", at(0), None)], f"u {kind}, c string, s timestamp, e timestamp")
    found = meetings.meeting_pairs(df, "u", "c", "s", "e", 15)
    got = found.collect()
    assert {(r["a"], r["b"]): (r["times"], r["minutes"], r["cells"]) for r in got} == plain(rows) and len(got) == len(plain(rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert meetings.meeting_pairs(df.where("u IS NULL"), "u", "c", "s", "e", 15).collect() == []


@pytest.mark.parametrize("at_once", [1, 50, 10**6])
def test_parts_of_a_group(monkeypatch, at_once):
    """The same rows, however few meetings are made at once."""
    monkeypatch.setattr(meetings, "AT_ONCE", at_once)
    monkeypatch.setattr(blocks, "PACKED", 70)
    rows = made(300, 30, 5, 4)
    visits = pa.Table.from_pylist([{"block": u % 2, "u": u, "cell": c, "s": int(s * 1e6), "lasts": int((e - s) * 1e6)} for u, c, s, e in rows if e - s >= 900])
    packed = pa.Table.from_batches(blocks.pack(["cell", "s"])(iter(visits.to_batches(max_chunksize=40)))).to_pylist()
    found = {}
    for i, j in ((0, 0), (0, 1), (1, 1)):
        group = [pa.RecordBatch.from_pylist([{"i": i, "j": j, **r}]) for r in packed if r["block"] in (i, j)]
        for r in (r for batch in meetings._group(900_000_000)(blocks.unpack(iter(group))) for r in batch.to_pylist()):
            assert (r["a"], r["b"]) not in found
            found[r["a"], r["b"]] = (r["times"], r["minutes"], r["cells"])
    assert found == plain(rows)

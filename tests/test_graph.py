"""Connected components against a plain union of sets."""

import math
import random
from collections import Counter
from itertools import combinations

from metroframe.operators import graph, relations, series
from metroframe.operators.graph import connected_components


def components(edges):
    of = {}
    for a, b in edges:
        if a is None or b is None:
            continue
        a, b = of.setdefault(a, a), of.setdefault(b, b)
        for n, c in of.items():
            if c == max(a, b):
                of[n] = min(a, b)
    return of


def found(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    rows = connected_components(spark, df, "a", "b").collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_components(spark):
    chance = random.Random(5)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(1000, 1000 + i) for i in range(30)]
    edges = path + star + [(chance.randrange(60), chance.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (4, None), (500, 500), path[0], path[0]]
    chance.shuffle(edges)
    assert found(spark, edges) == components(edges)
    assert found(spark, []) == {}


def test_popular_nodes(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 3)
    edges = [(1, i) for i in range(2, 60)] + [(i, i + 100) for i in range(2, 30)] + [(500, 501)]
    assert found(spark, edges) == components(edges)


def test_popular_partner(spark, monkeypatch):
    monkeypatch.setattr(relations, "BLOCK", 4)
    edges = [(m, "all") for m in range(25)] + [(m, "even") for m in range(0, 25, 2)] + [(3, "all"), (None, "all"), (4, None), (7, "one")]
    of = {}
    for m, p in set(edges) - {(None, "all"), (4, None)}:
        of.setdefault(p, set()).add(m)
    want = Counter(pair for members in of.values() for pair in combinations(sorted(members), 2))
    rows = relations.shared_partners(spark.createDataFrame(edges, "m long, p string"), "m", "p", 1).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in rows} == want and len(rows) == len(want)


def test_spacing(spark):
    hours = [0.0, 0.0, 10.0, 20.0, 7199.0, 7200.0, 7210.0, 90000.0, None]
    rows = spark.createDataFrame([("a", h) for h in hours] + [("b", 5.0), (None, 1.0), (None, 4.0)], "k string, s double").selectExpr("k", "timestamp_seconds(s) AS ts")
    got = {r["unique_id"]: (r["seconds"], r["n"]) for r in series.spacing(rows, "k", "ts").collect()}
    assert got == {"a": (10.0, 3), None: (3.0, 1)}


def test_spacing_at_half_a_millisecond(spark):
    """Distances are those of times in seconds as doubles, as the SQL has them, also where they end in half a millisecond."""
    chance, at, want = random.Random(5), 1_704_067_200_000_000, {}
    rows = []
    for key in range(200):
        at += chance.randrange(10**9)
        step = 1000 * chance.randrange(1, 60) + 500
        rows += [(key, at), (key, at + step)]
        want[key] = (math.floor(((at + step) / 1e6 - at / 1e6) * 1000 + 0.5) / 1000, 1)
    made = spark.createDataFrame(rows, "k long, us long").selectExpr("k", "timestamp_micros(us) AS ts")
    assert {r["unique_id"]: (r["seconds"], r["n"]) for r in series.spacing(made, "k", "ts").collect()} == want

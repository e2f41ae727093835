"""Betweenness, bridges and composite paths on small graphs, against plain searches."""

import math
import random
from collections import defaultdict, deque

import pytest

from metroframe.operators import centrality, composite


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def plain(edges):
    """Brandes."""
    near, out = near_of(edges), defaultdict(float)
    for s in near:
        order, before, paths, far, queue = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        part = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                out[w] += part[w]
    n = len(near)
    return {v: (out[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0, len(near[v])) for v in near}


def test_betweenness(spark):
    chance = random.Random(4)
    edges = [(chance.randrange(60), chance.randrange(60)) for _ in range(75)] + [(i, i + 1) for i in range(100, 108)] + [(3, 3), (None, 1), (2, None), (100, 101)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: (r["betweenness"], r["degree"]) for r in centrality.betweenness(df).collect()}
    want = plain(edges)
    assert set(got) == set(want) and all(got[n] == pytest.approx(want[n]) for n in want)
    part = centrality.betweenness(df, spark.createDataFrame([(n,) for n in want] + [(9999,)], "node long")).collect()
    assert all(r["betweenness"] == pytest.approx(want[r["node"]][0]) for r in part)


def test_small_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert centrality.betweenness(none).collect() == []
    two = centrality.betweenness(spark.createDataFrame([(1, 2)], "src long, dst long")).collect()
    assert sorted(tuple(r) for r in two) == [(1, 0.0, 1), (2, 0.0, 1)]


def test_bridges(spark):
    paths = spark.createDataFrame([([1, 2, 3], [None, "x"]), ([1, 4, 2, 3], ["y", None, "x"]), ([1, 3], [None])], "path array<long>, evidence array<string>")
    links = [(1, 2), (2, 3), (1, 4), (4, 2), (1, 3)]
    want = plain(links)
    got = [(r["node"], r["path_frequency"], r["degree"], r["score"]) for r in centrality.bridge_ranking(paths).collect()]
    assert got == [(2, 2, 3, round(6 + want[2][0] * 10 + 0.15, 6)), (4, 1, 2, round(3 + want[4][0] * 10 + 0.1, 6))]
    more = [(str(a), str(b)) for a, b in links] + [("2", "x"), ("x", "3"), ("1", "y"), ("y", "4")]
    want = plain(more)
    got = [(r["node"], r["path_frequency"], r["score"]) for r in centrality.evidence_bridges(paths).collect()]
    counts = {"2": 2, "4": 1, "x": 2, "y": 1}
    assert got == sorted(((n, f, round(f * 10 + want[n][1] + want[n][0] * 5, 6)) for n, f in counts.items()), key=lambda r: (-r[2], r[0]))


def plain_paths(calls, devices, source, target, hops, expansions, each, common, strategy, top):
    """A breadth-first search over lists."""
    w = composite.WEIGHTS
    partners = lambda n, table: {m: {i for a, i in table if a == m and i is not None} & {i for a, i in table if a == n} for m in {a for a, _ in table} - {n, None}}

    def all_of(n):
        call = defaultdict(int)
        for a, b in calls:
            if a == n and b is not None:
                call[b] += 1
        dev = {m: x for m, x in partners(n, devices).items() if x}
        cp = {m: x for m, x in partners(n, calls).items() if len(x) >= common}
        return [("call", {m: (c, None) for m, c in call.items()}), ("shared_device", {m: (len(x), str(min(x))) for m, x in dev.items()}), ("common_counterparty", {m: (len(x), str(min(x))) for m, x in cp.items()})]

    rank = lambda found: [x[:-1] for x in sorted(found, key=lambda p: ((p[2], -p[3]) if strategy == "shortest" else (-p[3], p[2]), p[4]))[:top]]
    direct = [((source, target), (r,), 1, round(w[r] * math.log1p(m[target][0]) - 0.3, 6), i) for i, (r, m) in enumerate(all_of(source)) if target in m]
    if direct:
        return rank(direct), False
    queue, depth, found, searched, truncated, order = deque([((source,), (), 0.0)]), {source: 0}, [], 0, False, 0
    while queue:
        path, rels, score = queue.popleft()
        if len(rels) >= hops:
            continue
        searched += 1
        if searched > expansions:
            truncated = True
            break
        best = {}
        for r, members in all_of(path[-1]):
            for m, (e, _) in sorted(members.items(), key=lambda x: (-x[1][0], x[0]))[:each]:
                worth = w[r] * math.log1p(e)
                if m not in best or worth > best[m][1]:
                    best[m] = (r, worth)
        for m, (r, worth) in best.items():
            if m in path:
                continue
            new = ((*path, m), (*rels, r), score + worth)
            if m == target:
                order += 1
                found.append((new[0], new[1], len(new[1]), round(new[2] - 0.3 * len(new[1]), 6), order))
            elif m not in depth or len(new[1]) <= depth[m]:
                depth[m] = len(new[1])
                queue.append(new)
    return rank(found), truncated


@pytest.mark.parametrize("seed,expansions,strategy", [(1, 500, "balanced"), (2, 500, "shortest"), (3, 6, "strongest"), (4, 500, "balanced")])
def test_composite_paths(spark, seed, expansions, strategy):
    chance = random.Random(seed)
    calls = [(chance.randrange(14), chance.randrange(18)) for _ in range(26)] + [(None, 3), (3, None)]
    devices = [(chance.randrange(16), chance.randrange(40)) for _ in range(26)] + [(None, 3), (3, None), (5, 7), (5, 7)]
    relations = composite.Relations(spark.createDataFrame(calls, "src long, dst long"), spark.createDataFrame(devices, "member long, device long"), each=3)
    for source, target in ((0, 13), (1, 12)):
        rows, state = composite.find(relations, source, target, expansions=expansions, strategy=strategy, top=5)
        got = [(tuple(r["path"]), tuple(r["relations"]), r["hops"], r["score"]) for r in rows.collect()]
        want, truncated = plain_paths(calls, devices, source, target, 3, expansions, 3, 2, strategy, 5)
        assert got == want and state["truncated"] == truncated


def test_one_end(spark):
    relations = composite.Relations(spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([], "member long, device long"))
    rows, state = composite.find(relations, 1, 1)
    assert [(r["path"], r["hops"], r["score"]) for r in rows.collect()] == [([1], 0, 0.0)] and state["direct"]
    assert composite.find(relations, 2, 7)[0].collect() == []

"""Louvain communities against a plain sequential Louvain, and modularity against its definition."""

import random
from collections import defaultdict

import pytest

from metroframe.operators import communities


def value(links, of, resolution=1.0):
    total = 2 * sum(links.values())
    k, inside = defaultdict(float), 0.0
    for (a, b), w in links.items():
        k[of[a]] += w
        k[of[b]] += w
        inside += 2 * w * (of[a] == of[b])
    return inside / total - resolution * sum(x * x for x in k.values()) / total**2


def plain(links, resolution=1.0):
    """Louvain, node by node."""
    near = defaultdict(lambda: defaultdict(float))
    for (a, b), w in links.items():
        near[a][b] += w
        near[b][a] += w
    loop, names = defaultdict(float), {n: {n} for n in near}
    total = sum(sum(x.values()) for x in near.values())
    while True:
        k = {n: sum(near[n].values()) + loop[n] for n in names}
        of, tot = {n: n for n in names}, dict(k)
        moved = any_move = True
        any_move = False
        while moved:
            moved = False
            for n in sorted(names):
                to = defaultdict(float)
                for m, w in near[n].items():
                    to[of[m]] += w
                tot[of[n]] -= k[n]
                best = max(sorted({*to, of[n]}), key=lambda c: (to[c] - resolution * k[n] * tot[c] / total, c == of[n]))
                moved |= best != of[n]
                any_move |= best != of[n]
                of[n] = best
                tot[best] += k[n]
        if not any_move:
            return {n: c for c, group in names.items() for n in group}
        merged, near2, loop2 = defaultdict(set), defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for n in names:
            merged[of[n]] |= names[n]
            loop2[of[n]] += loop[n]
            for m, w in near[n].items():
                if of[n] == of[m]:
                    loop2[of[n]] += w
                else:
                    near2[of[n]][of[m]] += w
        names, near, loop = dict(merged), near2, loop2


def planted(groups, size, inner, outer, seed):
    chance = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a) if chance.random() < (inner if a // size == b // size else outer)]


@pytest.mark.parametrize("edges", [planted(4, 9, 0.7, 0.04, 1), [(0, i) for i in range(1, 20)] + [(30, i) for i in range(31, 45)] + [(0, 30)]])
def test_louvain_is_not_below_a_plain_one(spark, edges):
    edges = [e if i % 2 else e[::-1] for i, e in enumerate(edges)] + edges[:5] + [(3, 3), (None, 1)]
    df = spark.createDataFrame(edges, "src long, dst long")
    links = {(min(e), max(e)): 1.0 for e in edges if None not in e and e[0] != e[1]}
    found = communities.louvain(df, seed=3)
    of = {r["node"]: r["community"] for r in found.collect()}
    assert set(of) == {n for e in links for n in e}
    assert all(of[c] == c and c <= n for n, c in of.items())
    assert value(links, of) >= value(links, plain(links)) - 1e-9
    row = communities.modularity(communities.undirected_links(df), found).first()
    assert (row["modularity"], row["communities"], row["nodes"]) == (pytest.approx(value(links, of)), len(set(of.values())), len(of))


def test_weights_and_resolution(spark):
    edges = [(1, 2, 10), (2, 1, 10), (3, 4, 10), (2, 3, 1), (5, 6, None), (5, 7, 0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    links = {(r["u"], r["v"]): r["w"] for r in communities.undirected_links(df, "weight").collect()}
    assert links == {(1, 2): 20, (3, 4): 10, (2, 3): 1}
    of = {r["node"]: r["community"] for r in communities.louvain(df, "weight").collect()}
    assert of == {1: 1, 2: 1, 3: 3, 4: 3}


def test_modularity_of_given_groups(spark):
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 2.0)], "u long, v long, w double")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, community long")
    row = communities.modularity(links, groups, 1.5).first()  # 4 is alone
    assert row["communities"] == 3 and row["modularity"] == pytest.approx(value({(1, 2): 1, (2, 3): 1, (3, 4): 2}, {1: 1, 2: 1, 3: 3, 4: 4}, 1.5))
    stats = {r["community"]: (r["nodes"], r["inside"], r["outside"], r["density"]) for r in communities.statistics(links, groups.unionByName(spark.createDataFrame([(4, 3), (9, 9)], groups.schema))).collect()}
    assert stats == {1: (2, 1, 1, 1.0), 3: (2, 1, 1, 1.0), 9: (1, 0, 0, 0.0)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert communities.louvain(none).collect() == []
    assert communities.modularity(communities.undirected_links(none), spark.createDataFrame([], "node long, community long")).first()["modularity"] == 0.0


def test_packed_links_give_the_same_moves(spark, monkeypatch):
    """Nodes look at the same from packed blocks as from joins, also in later levels (loops, whole weights, nodes without links), and communities are the same."""
    monkeypatch.setattr(communities, "BLOCK", 40)
    monkeypatch.setattr(communities, "NODES", 11)
    chance = random.Random(8)
    links = {(chance.randrange(30) - 5, chance.randrange(30) - 5): float(chance.randrange(1, 4)) for _ in range(120)}
    ends = [(a, b, w) for (a, b), w in links.items() if a < b]
    both = spark.createDataFrame(ends + [(b, a, w) for a, b, w in ends], "u long, v long, w double")
    state = spark.createDataFrame([(n, sum((w for a, b, w in ends if n in (a, b)), 0.0) + n % 3, float(n % 3), n // 4 * 4) for n in range(-5, 27)], "node long, k double, loop double, c long")
    total = sum(2 * w for _, _, w in ends) + 30
    packed = communities.Packed(both, state, 2 * len(ends))
    assert packed.n_blocks > 2 and packed.n_parts > 2
    found = [sorted(map(tuple, communities._look(state, x, total, 0.9).collect())) for x in (packed, both)]
    assert found[0] == found[1] and any(r[5] is not None for r in found[0]) and any(r[5] is None for r in found[0])
    edges = spark.createDataFrame(planted(3, 8, 0.7, 0.05, 2), "src long, dst long")
    ways = []
    for few in (1, 10**9):
        monkeypatch.setattr(communities, "FEW", few)
        ways.append(sorted(map(tuple, communities.louvain(edges, seed=3).collect())))
    assert ways[0] == ways[1]

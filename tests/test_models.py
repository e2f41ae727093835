"""Models, warped trips, tracks and distances against plain loops: nulls, ties, repeats, no rows."""

import datetime
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metroframe.operators import models, near, patches, tracking, warping


def plain_forecast(y, season, horizon, alpha=0.3, beta=0.1, gamma=0.2):
    n = len(y)
    if n < 2 * season or season < 2:
        level = y[0]
        for v in y:
            level = alpha * v + (1 - alpha) * level
        return [max(0.0, level)] * horizon
    whole = n // season
    overall = sum(y[: whole * season]) / (whole * season)
    cycle = [sum(y[k::season][:whole]) / whole - overall for k in range(season)]
    level, trend = sum(y[:season]) / season, (sum(y[season : 2 * season]) - sum(y[:season])) / season**2
    for i in range(1, n):
        before = level
        level = alpha * (y[i] - cycle[i % season]) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        cycle[i % season] = gamma * (y[i] - level) + (1 - gamma) * cycle[i % season]
    return [max(0.0, level + h * trend + cycle[(n + h - 1) % season]) for h in range(1, horizon + 1)]


@pytest.mark.parametrize("season", [1, 3, 7])
def test_holt_winters(spark, season):
    chance = random.Random(season)
    series = [[chance.uniform(-5, 30) for _ in range(n)] for n in (1, 2, 5, 6, 7, 13, 14, 15, 28, 40)] + [[-3.0] * 20]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(series)], "id int, y array<double>")
    got = {r["id"]: r["f"] for r in df.select("id", models.holt_winters(F.col("y"), season, 4).alias("f")).collect()}
    for i, y in enumerate(series):
        assert got[i] == pytest.approx(plain_forecast(y, season, 4))


def test_region_forecasts(spark):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    rows = [("a", day(d), float(d % 7)) for d in range(40)] + [("a", day(39), 2.0), ("b", day(1), 1.0), ("b", day(4), 2.0), ("c", day(0), 5.0), ("c", day(2), 1.0), ("c", day(4), 9.0)]
    rows += [(None, day(1), 1.0), ("a", None, 1.0), ("a", day(3), None)]
    found = models.region_forecasts(spark.createDataFrame(rows, "region string, ts timestamp, y double"), 7, 2, 7).orderBy("region", "step").collect()
    a = [float(d % 7) for d in range(12, 39)] + [39 % 7 + 2.0]
    assert [(r["region"], r["ts"], r["step"], r["history"]) for r in found] == [("a", day(40), 1, 28), ("a", day(41), 2, 28), ("c", day(6), 1, 3), ("c", day(8), 2, 3)]
    assert [r["forecast"] for r in found] == pytest.approx(plain_forecast(a, 7, 2) + plain_forecast([5.0, 1.0, 9.0], 7, 2))
    assert models.region_forecasts(spark.createDataFrame([], "region string, ts timestamp, y double")).collect() == []


def test_kmeans(spark):
    chance = np.random.default_rng(3)
    points = np.concatenate([chance.normal(c, 0.4, (30, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 5))])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(900, None), (901, [0.0, 0.0, 0.0]), (902, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    found, centres = models.kmeans(df, 3, seed=1)
    of = {r["id"]: r["cluster"] for r in found.collect()}
    assert set(of) == {i for i, f in rows if f is not None}
    for c in range(3):  # a fixed point of Lloyd's step
        assert centres[c] == pytest.approx(np.mean([f for i, f in rows if f is not None and of[i] == c], axis=0))
    for i, f in rows:
        if f is not None:
            assert of[i] == int(np.argmin([((np.array(f) - c) ** 2).sum() for c in centres]))
    again = {r["id"]: r["cluster"] for r in models.kmeans(df.repartition(3), 3, seed=1)[0].collect()}
    assert again == of
    few, centres = models.kmeans(df.where("id < 2"), 4)
    assert len(centres) == 2 and sorted(r["cluster"] for r in few.collect()) == [0, 1]
    assert models.kmeans(df.limit(0), 3)[0].collect() == []


def test_components(spark):
    chance = np.random.default_rng(5)
    x = chance.normal(size=(80, 4)) @ np.diag([5, 2, 1, 0.5]) + 3
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>").repartition(5)
    mean, vectors = models.components(df, 4, 2)
    assert mean == pytest.approx(x.mean(axis=0))
    plain = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    assert np.abs((vectors * plain).sum(axis=1)) == pytest.approx(1.0)


def test_component_anomalies(spark):
    day = lambda d: datetime.date(2024, 1, 1) + datetime.timedelta(days=d)
    chance = np.random.default_rng(1)
    base = chance.normal(10, 4, 40)
    wide = np.stack([base, 2 * base + chance.normal(0, 0.1, 40), -base + chance.normal(0, 0.1, 40)], axis=1)
    wide[25, 1] += 30
    rows = [(f"s{j}", day(d), float(wide[d, j])) for d in range(40) for j in range(3) if (d, j) not in ((0, 0), (7, 1), (8, 1), (39, 2))] + [("s0", None, 1.0), ("none", day(1), None)]
    found = models.component_anomalies(spark.createDataFrame(rows, "unique_id string, ds date, y double"), 1, 5.0).orderBy("ds").collect()
    filled = wide.copy()
    filled[0, 0], filled[39, 2] = wide[1, 0], wide[38, 2]
    filled[7, 1], filled[8, 1] = (wide[6, 1] + (wide[9, 1] - wide[6, 1]) * s / 3 for s in (1, 2))
    off = filled - filled.mean(axis=0)
    first = np.linalg.svd(off, full_matrices=False)[2][0]
    error = (off**2).sum(axis=1) - (off @ first) ** 2
    low, high = np.quantile(error, [0.25, 0.75])
    assert [r["error"] for r in found] == pytest.approx(error.tolist(), abs=1e-6)
    assert [r["anomaly"] for r in found] == (error > high + 5 * (high - low)).tolist() and found[25]["anomaly"]
    assert models.component_anomalies(spark.createDataFrame(rows[:5], "unique_id string, ds date, y double")).collect() == []


def plain_warp(a, b, band):
    n, m = len(a), len(b)
    w = max(band, abs(n - m))
    best = {(0, 0): 0.0}
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            (p, q), (r, s) = np.radians(a[i - 1]), np.radians(b[j - 1])
            h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
            best[i, j] = 2 * warping.RADIUS * math.asin(math.sqrt(h)) + min(best.get(x, math.inf) for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return best[n, m] / (n + m)


def test_warped_trips(spark, monkeypatch):
    monkeypatch.setattr(warping, "TOGETHER", 4)
    chance = random.Random(8)
    trips = []
    for i in range(60):
        at, path = [30 + chance.random(), 179.5 + chance.random()], []
        for _ in range(chance.randint(1, 40)):
            at = [at[0] + chance.uniform(-0.02, 0.02), at[1] + chance.uniform(-0.02, 0.02)]
            path.append((at[0], at[1] if at[1] <= 180 else at[1] - 360))
        trips.append((i, path))
    trips += [(60, trips[5][1]), (61, trips[5][1]), (62, []), (63, None), (64, [(None, 1.0)]), (None, trips[5][1])]
    df = spark.createDataFrame([(i, p and [{"lat": a, "lon": b} for a, b in p]) for i, p in trips], "id long, path array<struct<lat:double,lon:double>>").repartition(3)
    got = defaultdict(list)
    for r in warping.alike(df, [5, 9, 62, 777], k=6, band=4, points=15).orderBy("target", "rank").collect():
        got[r["target"]].append((r["metres"], r["trip"], r["n_points"]))
    paths = {i: warping.shortened([x for x in p or [] if None not in x], 15) for i, p in trips if i is not None}
    for target in (5, 9):
        want = sorted((round(plain_warp(paths[target], p, 4), 2), i, len(p)) for i, p in paths.items() if i != target and p)
        assert got[target] == want[:6]
    assert set(got) == {5, 9}
    for i, p in paths.items():
        if p:
            bound = warping.lower_bound(np.radians(paths[5]), np.radians(p), 4)
            assert bound <= plain_warp(paths[5], p, 4) * (1 + 1e-9) + 1e-6


def test_tracks(spark):
    chance = random.Random(6)
    start = datetime.datetime(2024, 5, 1)
    rows = []
    for n in range(400):
        x, y = chance.uniform(0, 400), chance.uniform(0, 300)
        rows.append((chance.choice(["c1", "c2", None]), chance.choice(["car", "bus"]), start + datetime.timedelta(seconds=chance.randint(0, 900)), n // 3, n % 3, x, y, x + 10, y + 20, chance.choice([None, 0.5, 0.9])))
    rows += [("c1", "car", None, 1, 1, 1.0, 1.0, 2.0, 2.0, 0.1), ("c1", "car", start, 0, 0, None, 1.0, 2.0, 2.0, 0.1), ("c1", "bus", start, -1, 0, 5.0, 5.0, 5.0, 5.0, 1.0)]
    schema = "camera string, label string, ts timestamp, frame int, number int, x1 double, y1 double, x2 double, y2 double, confidence double"
    for expires in (None, 60.0):
        found = tracking.associate(spark.createDataFrame(rows, schema).repartition(5), 40.0, expires)
        got = {(r["camera"], r["label"], r["frame"], r["number"]): r["track"] for r in found.collect()}
        live, count, want, members = defaultdict(list), defaultdict(int), {}, defaultdict(list)
        for r in sorted((r for r in rows if r[2] and r[5] is not None), key=lambda r: r[2:5]):
            key, x, y = r[:2], (r[5] + r[7]) / 2, (r[6] + r[8]) / 2
            if expires is not None:
                live[key] = [t for t in live[key] if (r[2] - t[3]).total_seconds() <= expires]
            near_by = [t for t in live[key] if math.hypot(t[1] - x, t[2] - y) <= 40]
            if near_by:
                track = min(near_by, key=lambda t: math.hypot(t[1] - x, t[2] - y))
            else:
                count[key] += 1
                track = [count[key], x, y, r[2]]
                live[key].append(track)
            track[1:] = [x, y, r[2]]
            want[(*key, r[3], r[4])] = track[0]
            members[(*key, track[0])].append((x, y, r[2], r[9] or 0.0))
        assert {k: v for k, v in got.items() if v is not None} == want and len(got) == len(rows)
        for r in tracking.tracks(found).collect():
            m = members.pop((r["camera"], r["label"], r["track"]))
            moved = math.hypot(m[-1][0] - m[0][0], m[-1][1] - m[0][1])
            assert (r["started"], r["ended"], r["detections"]) == (m[0][2], m[-1][2], len(m))
            assert r["state"] == ("stationary" if moved <= 20 else "moving") and r["moved"] == pytest.approx(moved, abs=1e-4)
            assert r["seconds"] == int((m[-1][2] - m[0][2]).total_seconds()) and r["confidence"] == pytest.approx(sum(x[3] for x in m) / len(m), abs=1e-4)
        assert not members
    assert tracking.tracks(tracking.associate(spark.createDataFrame([], schema))).collect() == []


def test_any_near(spark):
    chance = random.Random(2)
    rows = [(chance.choice([f"g{i}" for i in range(25)] + [None]), chance.uniform(-200, 200), chance.uniform(-200, 200)) for _ in range(120)] + [("edge", 0.0, 0.0), ("edge", 50.0, 0.0), ("apart", 0.0, 0.0), ("apart", 50.001, 0.0), ("one", 1.0, 1.0), ("one", None, 1.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0)]
    got = {r["_k0"]: (r["n"], r["near"]) for r in near.any_near(spark.createDataFrame(rows, "_k0 string, x double, y double"), ["_k0"], "x", "y", 50.0).collect()}
    groups = defaultdict(list)
    for g, x, y in rows:
        if x is not None:
            groups[g].append((x, y))
    assert got == {g: (len(p), any(math.dist(a, b) <= 50 for i, a in enumerate(p) for b in p[:i])) for g, p in groups.items()}


@pytest.mark.parametrize("side", [1.0, 7.5])
def test_nearest(spark, side):
    chance = random.Random(3)
    targets = [(chance.uniform(-50, 400), chance.uniform(-50, 90)) for _ in range(60)] + [(5.0, 5.0)] * 3 + [(200.0 + i / 100, 50.0) for i in range(300)] + [(None, 1.0)]
    points = [(i, chance.uniform(-600, 600), chance.uniform(-600, 600)) for i in range(50)] + [(50, 5.0, 5.0), (51, None, 1.0), (52, 200.0, 51.0), (3, 0.0, 0.0), (None, 1.0, 1.0)]
    found = near.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "x double, y double"), side)
    got = sorted(((r["id"] is None, r["id"] or 0, r["distance"]) for r in found.collect()))
    want = sorted((i is None, i or 0, min(math.hypot(x - a, y - b) for a, b in targets if a is not None)) for i, x, y in points if x is not None)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    none = spark.createDataFrame([], "x double, y double")
    assert {r["distance"] for r in near.nearest(spark.createDataFrame(points, "id long, x double, y double"), none).collect()} == {None}


def test_growth_patterns(spark):
    pixels = lambda cells: spark.createDataFrame(cells, "x long, y long")
    old = [(x, y) for x in range(0, 5) for y in range(0, 5) if (x, y) != (2, 2)]
    new = [(2, 2), (5, 0), (5, 1), (6, 0), (18, 18), (19, 18)]
    found = near.growth_patterns(patches.patches(pixels(new), "x", "y"), pixels(old), 20, 20, 10.0, leapfrog_m=100.0).collect()
    got = {(r["n_pixels"], r["pattern"], round(r["old_share"], 6), round(r["distance_m"], 6)) for r in found}
    assert got == {(1, "infilling", 1.0, 10.0), (3, "edge-expansion", round(2 / 5, 6), 10.0), (2, "leapfrog", 0.0, round(math.hypot(14, 14) * 10, 6))}
    alone = near.growth_patterns(patches.patches(pixels(new[:1]), "x", "y"), pixels([]), 20, 20, 10.0).collect()
    assert [(r["pattern"], r["distance_m"]) for r in alone] == [("leapfrog", None)]


def test_shelter_gaps(spark):
    risky = spark.createDataFrame([(x, y) for x in range(10) for y in range(3)], "x long, y long")
    found = near.shelter_gaps(risky, spark.createDataFrame([(0, 1)], "x long, y long"), 45.0, 10.0, 2).collect()
    assert [(r["n_pixels"], r["min_x"], r["max_x"]) for r in found] == [(15, 5, 9)]

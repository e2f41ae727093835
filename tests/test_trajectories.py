"""Operators in which each point depends on what became of those before it, against plain loops."""

import datetime as dt
import math
import random
from collections import defaultdict

from metroframe.operators import trajectories

SCHEMA = "user long, at timestamp_ntz, lat double, lon double, n long"


def km(a, b):
    half = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(half))


def made():
    rng, rows, start = random.Random(6), [], dt.datetime(2024, 1, 1)
    for user in range(6):
        lat, lon, t = 30.0, 120.0, start
        for _ in range(0 if user == 5 else 120):
            t += dt.timedelta(minutes=rng.choice([0, 3, 10, 40]))
            far = 0.5 if rng.random() < 0.1 else 0.002
            lat, lon = lat + rng.uniform(-far, far), lon + rng.uniform(-far, far)
            rows.append((user, t, lat, lon, len(rows)))
    return rows


def by_user(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        found[r[0]].append(r)
    return found.values()


def test_jumps(spark):
    want = []
    for own in by_user(made()):
        last = None
        for r in own:
            hours = (r[1] - last[1]).total_seconds() / 3600 if last else 0
            if last and hours > 0 and km(last, r) / hours > 60:
                continue
            want.append(r[4])
            last = r
    df = spark.createDataFrame(made(), SCHEMA).repartition(3)
    assert sorted(r["n"] for r in trajectories.without_jumps(df, "user", "at", "lat", "lon", "n", 60.0).collect()) == sorted(want) and len(want) < len(made())
    assert trajectories.without_jumps(df.limit(0), "user", "at", "lat", "lon", "n", 60.0).collect() == []


def test_stays(spark):
    want = []
    for own in by_user(made()):
        i = 0
        while i < len(own):
            j = next((j for j in range(i + 1, len(own)) if km(own[i], own[j]) > 0.4), None)
            minutes = (own[j - 1][1] - own[i][1]).total_seconds() / 60 if j else -1
            if minutes >= 20:
                want.append((own[i][0], own[i][1], own[j - 1][1], round(minutes, 3), j - i))
                i = j
            else:
                i += 1
    df = spark.createDataFrame(made(), SCHEMA).repartition(3)
    got = trajectories.stays(df, "user", "at", "lat", "lon", "n", 400.0, 20.0).collect()
    assert sorted((r["user"], r["started"], r["ended"], r["minutes"], r["points"]) for r in got) == sorted(want) and want
    assert trajectories.stays(df.limit(0), "user", "at", "lat", "lon", "n", 400.0, 20.0).collect() == []

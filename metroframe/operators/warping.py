"""Trips that go alike: dynamic time warping within a band, behind a lower bound.

The trips that are asked about go to every task. Each task takes its trips in Arrow batches, bounds every distance from below by
the boxes around what a point may be matched with, and computes a distance only while the bound is within reach of the k best
that it has; it hands on k trips for each one asked about."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Metres of the earth's radius.
RADIUS = 6_371_008.8
#: Trips whose distances are computed together.
TOGETHER = 64


def shortened(points: list, most: int) -> list:
    """At most so many points, evenly by number."""
    return points if len(points) <= most else [points[int(i * len(points) / most)] for i in range(most)]


def _haversine(a, b):
    """Metres between points in radians, arrays (..., 2)."""
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))


def lower_bound(target: np.ndarray, trip: np.ndarray, band: int) -> float:
    """No more than the mean step of warping one trip on the other: each point costs at least its way to the box around the points that it may be matched with."""
    n, m = len(target), len(trip)
    w = max(band, abs(n - m))
    # a point of the trip meets those of the target whose places differ by w at most; there is always one
    wide = np.full((max(n, m) + 2 * w, 2), np.nan)
    wide[w : w + n] = target
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * w + 1, axis=0)[:m]
    boxes = np.concatenate([np.fmin.reduce(windows, axis=2), np.fmax.reduce(windows, axis=2)], axis=1)
    up = np.maximum(np.maximum(boxes[:, 0] - trip[:, 0], trip[:, 0] - boxes[:, 2]), 0)
    near = np.maximum(np.maximum(boxes[:, 1] - trip[:, 1], trip[:, 1] - boxes[:, 3]), 0)
    far = np.maximum(np.abs(boxes[:, 1] - trip[:, 1]), np.abs(trip[:, 1] - boxes[:, 3]))
    across = np.minimum(np.sin(near / 2) ** 2, np.where(near > 0, np.sin(far / 2) ** 2, 0))
    cosine = np.minimum(np.cos(boxes[:, 0]), np.cos(boxes[:, 2])).clip(0)
    h = np.sin(up / 2) ** 2 + np.cos(trip[:, 0]) * cosine * across
    return float((2 * RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1)))).sum() / (n + m))


def distances(target: np.ndarray, trips: np.ndarray, band: int) -> np.ndarray:
    """The mean step of warping each of several trips of equal length (trips, points, 2) on the target."""
    n, m = len(target), trips.shape[1]
    w = max(band, abs(n - m))
    row = np.full((m + 1, len(trips)), np.inf)
    row[0] = 0
    for i in range(1, n + 1):
        low, high = max(1, i - w), min(m, i + w)
        new = np.full_like(row, np.inf)
        cost = _haversine(target[i - 1], trips[:, low - 1 : high]).T
        before = np.minimum(row[low : high + 1], row[low - 1 : high])
        for j in range(low, high + 1):
            new[j] = cost[j - low] + np.minimum(before[j - low], new[j - 1])
        row = new
    return row[m] / (n + m)


def alike(trips: DataFrame, asked: list, k: int = 10, band: int = 10, points: int = 100) -> DataFrame:
    """(target, rank, trip, metres, n_points): for each trip asked about (a list of ids) the k nearest others of trips (id, path array<struct<lat, lon>>), in order.

    A path is shortened to so many points, evenly; the distance is the sum of steps of the best warping within the band (at least the difference of lengths),
    over the number of points of both, rounded to centimetres. Ties go by id. Points with a null are left out; trips without points, and those asked about that
    aren't there, have no rows. Trips that repeat an id are trips each, but never their own neighbour by id. The trips asked about are broadcast: keep them few."""
    spark = trips.sparkSession
    held = trips.where(F.col("id").isin(*asked)).select("id", "path").collect()  # as many as were asked about
    radians = lambda path: np.radians(np.array(shortened([(p["lat"], p["lon"]) for p in path or [] if p is not None and p["lat"] is not None and p["lon"] is not None], points), float).reshape(-1, 2))
    targets = [(r["id"], radians(r["path"])) for r in held]
    shared = spark.sparkContext.broadcast([(i, t) for i, t in targets if len(t)])

    def run(batches):
        import pyarrow as pa

        best: list[list[tuple]] = [[] for _ in shared.value]
        for batch in batches:
            rows = [(i, radians(path)) for i, path in zip(batch["id"].to_pylist(), batch["path"].to_pylist())]
            rows = [(i, t) for i, t in rows if len(t)]
            for at, (target, own) in enumerate(shared.value):
                waiting = sorted((lower_bound(own, t, band), i, n) for n, (i, t) in enumerate(rows) if i != target)
                while waiting:
                    reach = best[at][-1][0] if len(best[at]) == k else np.inf
                    taken = [x for x in waiting[:TOGETHER] if x[0] <= reach + 0.01]
                    waiting = waiting[TOGETHER:] if len(taken) == TOGETHER else []
                    by_length: dict[int, list[int]] = {}
                    for _, _, n in taken:
                        by_length.setdefault(len(rows[n][1]), []).append(n)
                    new = [(round(float(d), 2), rows[n][0], len(rows[n][1])) for group in by_length.values() for n, d in zip(group, distances(own, np.stack([rows[n][1] for n in group]), band))]
                    best[at] = sorted(best[at] + new)[:k]
        out = [(target, *x) for (target, _), found in zip(shared.value, best) for x in found]
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["target", "metres", "trip", "n_points"])

    found = trips.where("id IS NOT NULL").select("id", "path").mapInArrow(run, "target long, metres double, trip long, n_points long")
    rank = F.row_number().over(Window.partitionBy("target").orderBy("metres", "trip", "n_points"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("target", "rank", "trip", "metres", "n_points")

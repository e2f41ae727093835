"""Tracks from detections: each detection joins the nearest live track of its label, or begins one.

What a detection does depends on all before it, so a camera and label is one sequence: Spark deals and sorts the sequences, and a task
folds the rows of its sequences as they stream by in Arrow batches. A task holds the tracks of one sequence, never its rows; with a
time after which a track is lost (expires), the tracks it holds are those seen since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGNED = "track long, x double, y double"


def associate(detections: DataFrame, most: float = 80.0, expires: float | None = None, keys: tuple[str, ...] = ("camera", "label")) -> DataFrame:
    """detections (keys, ts, frame, number, x1, y1, x2, y2, ...) with the number of their track (from 1 within the keys, in order of its start) and centres x, y.

    In order of time, frame and number, a detection is given to the track whose last centre is nearest, if that is at most so many
    pixels away; of equally near ones the earlier track's. With expires, a track that has not been seen for more than so many seconds
    is over. Detections without time or with a null corner have no track. Null keys are a key like others.
    """
    from pyspark.sql.types import StructType

    spark = detections.sparkSession
    corners = ["x1", "y1", "x2", "y2"]
    known = F.col("ts").isNotNull()
    for c in corners:
        known &= F.col(c).isNotNull()
    centres = detections.withColumns({"_x": (F.col("x1") + F.col("x2")) / 2.0, "_y": (F.col("y1") + F.col("y2")) / 2.0, "_t": F.when(known, F.unix_micros(F.col("ts").cast("timestamp")))})
    sequence = F.to_json(F.struct(*(F.col(k).cast("string") for k in keys)), {"ignoreNullFields": "false"})
    ordered = centres.withColumn("_key", sequence).repartition("_key").sortWithinPartitions("_key", "_t", "frame", "number")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        present, last, live, n = None, None, [], 0  # live: [track, x, y, time]
        for batch in batches:
            keys_of, times = batch["_key"].to_pylist(), batch["_t"].to_pylist()
            xs, ys = batch["_x"].to_pylist(), batch["_y"].to_pylist()
            tracks: list[int | None] = []
            for key, t, x, y in zip(keys_of, times, xs, ys):
                if key != present:
                    present, live, n = key, [], 0
                if t is None:
                    tracks.append(None)
                    continue
                if expires is not None:
                    live = [track for track in live if t - track[3] <= expires * 1e6]
                found = None
                if live:
                    near = np.hypot(np.array([track[1] for track in live]) - x, np.array([track[2] for track in live]) - y)
                    i = int(near.argmin())
                    found = live[i] if near[i] <= most else None
                if found is None:
                    n += 1
                    found = [n, x, y, t]
                    live.append(found)
                found[1:] = [x, y, t]
                tracks.append(found[0])
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_key", "_t", "_x", "_y")]
            names = [name for name in batch.schema.names if name not in ("_key", "_t", "_x", "_y")]
            own = [pa.array(tracks, pa.int64()), *(pa.array([v if k is not None else None for v, k in zip(c, tracks)], pa.float64()) for c in (xs, ys))]
            yield pa.RecordBatch.from_arrays([*columns, *own], names=[*names, "track", "x", "y"])

    schema = StructType([*detections.schema.fields, *StructType.fromDDL(ASSIGNED).fields])
    return ordered.mapInArrow(run, schema)


def tracks(assigned: DataFrame, still: float = 20.0, keys: tuple[str, ...] = ("camera", "label")) -> DataFrame:
    """A row for each track of associate(): keys, track, started, ended, seconds, detections, moved (from the first centre to the last), state, confidence.

    A track that moved at most so many pixels is stationary, else moving. confidence is the mean, null counting as 0."""
    order = F.struct("ts", "frame", "number")
    rows = assigned.where("track IS NOT NULL").groupBy(*keys, "track").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("detections"), F.min_by(F.struct("x", "y"), order).alias("a"), F.max_by(F.struct("x", "y"), order).alias("b"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 4).alias("confidence"),
    )
    moved = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    seconds = F.floor((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000)
    state = F.when(moved <= still, "stationary").otherwise("moving")
    return rows.select(*keys, "track", "started", "ended", seconds.alias("seconds"), "detections", F.round(moved, 4).alias("moved"), state.alias("state"), "confidence")

"""Queries that read their table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import load, scratch
from ..streaming import windows
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT event_type AS key, ts::DATE AS ds, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3")
def streamed_hours(spark, folder):
    """Events of each type and hour, counted by a stream in batches of files until all are read. Files may come in any order, so there is no watermark: all rows count."""
    stream = spark.readStream.schema(load(spark, folder, "events").schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/events.parque[t]")
    path = scratch(spark, "stream")
    windows.write_updates(windows.window_counts(stream, "event_type", "ts", "1 hour"), f"{path}/table", f"{path}/state").awaitTermination()
    return windows.latest(spark, f"{path}/table", ["key", "start"]).select("key", F.to_date("start").alias("ds"), F.hour("start").alias("hour"), "n")

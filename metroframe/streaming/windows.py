"""Counts over event-time windows of a stream, and a table with the latest value of each window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_counts(stream: DataFrame, key: str, ts: str, width: str, lateness: str | None = None) -> DataFrame:
    """Rows of each key in each window (key, start, n). With a lateness, state of older windows is dropped, and so are rows that come later still; without, all rows count and all windows stay."""
    timed = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("_ts"))
    timed = timed.withWatermark("_ts", lateness) if lateness else timed
    return timed.groupBy(F.window("_ts", width).alias("w"), "key").agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "n")


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch changes to a folder of its own: a batch that is repeated after a failure replaces it. Takes what there is, then ends."""
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # so that a stream without rows has a table

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")

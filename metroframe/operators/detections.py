"""Tracks and events from detections: persistence, density, composition, templates, merging, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tracks(seen: DataFrame, keys: list[str], ts: str, place: str, confidence: str) -> DataFrame:
    """A row per track: seconds between its first and last detection, mean confidence, whether it was in more than one place."""
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))
    return seen.groupBy(*keys).agg((span / 1e6).alias("seconds"), F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.when(F.min(place) != F.max(place), "moving").otherwise("stationary").alias("state"))


def density(seen: DataFrame, keys: list[Column], track: str, bounds: dict[str, int]) -> DataFrame:
    """Different tracks for each key and the highest bound that they reach; keys below all bounds go."""
    level = F.coalesce(*(F.when(F.col("n_tracks") >= b, name) for name, b in sorted(bounds.items(), key=lambda x: -x[1])))
    return seen.groupBy(*keys).agg(F.countDistinct(track).alias("n_tracks")).withColumn("level", level).where("level is not null")


def composition(seen: DataFrame, keys: list[Column], label: str, least: dict[str, int]) -> DataFrame:
    """Keys with at least so many detections of each label."""
    counts = seen.groupBy(*keys).agg(*(F.count_if(F.col(label) == k).alias(f"n_{k}") for k in least))
    for k, n in least.items():
        counts = counts.where(F.col(f"n_{k}") >= n)
    return counts


def template(rows: DataFrame, key: str, methods: dict[str, tuple[Column, float]], need: float) -> DataFrame:
    """Keys whose methods' weights add up to at least need of all, with the score and an id that depends on the key alone."""
    total = sum(w for _, w in methods.values())
    score = sum((F.when(hit, w).otherwise(0.0) for hit, w in methods.values()), F.lit(0.0)) / total
    return rows.withColumn("score", score).where(F.col("score") >= need).withColumn("event_key", F.substring(F.sha1(F.col(key).cast("string")), 1, 16))


def merge(found: DataFrame, keys: list[str], track: str, start: str, end: str, confidence: str) -> DataFrame:
    """One event for each key: its tracks, the earliest start, the latest end, the highest confidence."""
    return found.groupBy(*keys).agg(F.countDistinct(track).alias("n_tracks"), F.min(start).alias("started"), F.max(end).alias("ended"), F.max(confidence).alias("confidence"), F.count("*").alias("n_merged"))


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, comma-joined; empty if none does."""
    return F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items()))


def health(summary: DataFrame, score: str) -> DataFrame:
    """Adds state (ok, degraded below 55, unavailable at 0 or null) and weight, by which a camera's confidences are multiplied."""
    state = F.when(F.coalesce(F.col(score), F.lit(0)) <= 0, "unavailable").when(F.col(score) < 55, "degraded").otherwise("ok")
    return summary.withColumn("state", state).withColumn("weight", F.when(F.col("state") == "ok", 1.0).when(F.col("state") == "degraded", 0.85).otherwise(0.0))


def sampled(spans: DataFrame, start: str, end: str, every: str) -> DataFrame:
    """A row for each time at which a frame is taken: from start to end, every so long."""
    return spans.withColumn("frame_at", F.explode(F.sequence(start, end, F.expr(f"INTERVAL {every}"))))

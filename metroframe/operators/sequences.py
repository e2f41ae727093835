"""Sequences of places per subject: runs, transitions, n-grams, the likely next place, merged intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse(visits: DataFrame, user: str, place: str, ts: str, tie: str) -> DataFrame:
    """Visits whose place differs from the one before."""
    before = F.lag(place).over(Window.partitionBy(user).orderBy(ts, tie))
    return visits.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(place))).drop("_before")


def transitions(visits: DataFrame, user: str, place: str, ts: str, tie: str) -> DataFrame:
    """Moves from each place to the next other one: number, and share of all moves from there."""
    following = visits.select(F.col(place).alias("origin"), F.lead(place).over(Window.partitionBy(user).orderBy(ts, tie)).alias("destination"))
    counted = following.where("origin != destination").groupBy("origin", "destination").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("origin")), 6))


def ngrams(visits: DataFrame, user: str, place: str, ts: str, tie: str, longest: int) -> DataFrame:
    """Runs of 2 to so many places in a row, with the number of users that have them. One sort per user serves every length."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    ahead = collapse(visits, user, place, ts, tie).select(F.col(user).alias("_user"), F.col(place).alias("_0"), *(F.lead(place, i).over(order).alias(f"_{i}") for i in range(1, longest)))
    found = F.array(*(F.when(F.col(f"_{n - 1}").isNotNull(), F.concat_ws(">", *(f"_{i}" for i in range(n)))) for n in range(2, longest + 1)))
    patterns = ahead.select("_user", F.explode(F.array_compact(found)).alias("pattern"))
    return patterns.groupBy("pattern").agg(F.count_distinct("_user").alias("support"), F.count("*").alias("times"))


def next_places(visits: DataFrame, user: str, place: str, ts: str, tie: str, slot: Column, least: int, k: int) -> DataFrame:
    """The k likeliest next places from each place in each slot of the day: by that slot's moves if there are enough, else by all moves."""
    moves = visits.select(F.col(place).alias("origin"), slot.alias("slot"), F.lead(place).over(Window.partitionBy(user).orderBy(ts, tie)).alias("destination")).where("origin != destination")
    by_slot = moves.groupBy("origin", "slot", "destination").agg(F.count("*").alias("n"))
    totals = by_slot.groupBy("origin", "slot").agg(F.sum("n").alias("seen"))
    overall = by_slot.groupBy("origin", "destination").agg(F.sum("n").alias("n"))
    dense = totals.where(F.col("seen") >= least).join(by_slot, ["origin", "slot"])
    sparse = totals.where(F.col("seen") < least).join(overall, "origin")
    chosen = reduce(DataFrame.unionByName, (d.select("origin", "slot", "destination", "n") for d in (dense, sparse)))
    rank = F.row_number().over(Window.partitionBy("origin", "slot").orderBy(F.desc("n"), "destination"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= k)


def merged_intervals(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that overlap or touch, as one."""
    order = Window.partitionBy(key).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(F.col(start) <= latest, 0).otherwise(1))
    grouped = marked.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_group")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the least by order; pre-aggregated before rows are dealt."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(order, *(c for c in others if c != order))).alias("_f")).select(*keys, *(F.col(f"_f.{c}").alias(c) for c in others))

"""Movement of subjects between places over time: flows, trips, heat, impact of events, anonymous buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def origin_destination(visits: DataFrame, user: str, place: str, ts: str, tie: str) -> DataFrame:
    """Moves between different places in a row: flow, distinct users and mean hours of each (origin, destination)."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    hours = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3.6e9
    moves = visits.select(user, place, ts, F.lead(place).over(order).alias("destination"), F.lead(ts).over(order).alias("next_ts")).where(F.col("destination") != F.col(place))
    return moves.groupBy(F.col(place).alias("origin"), "destination").agg(F.count("*").alias("flow"), F.count_distinct(user).alias("n_users"), F.round(F.avg(hours), 4).alias("mean_hours"))


def trips(visits: DataFrame, user: str, ts: str, tie: str, gap_hours: float) -> DataFrame:
    """Runs of a user's rows without a gap over so many hours: number, start, end and rows of each trip."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    begins = (micros - F.lag(micros).over(order)) > gap_hours * 3.6e9
    numbered = visits.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("trip", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "trip").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_points"))


def heat(visits: DataFrame, user: str, category: str, ts: str, k: int = 5) -> DataFrame:
    """Rows, distinct users and the k most frequent categories of each day and hour."""
    hours = visits.select(F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), F.col(user).alias("_u"), F.col(category).alias("_c"))
    by_category = hours.groupBy("day", "hour", "_c").agg(F.count("*").alias("n"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("_c").alias("c")))), 1, k)
    top = by_category.groupBy("day", "hour").agg(F.sum("n").alias("n_rows"), F.array_join(F.transform(ranked, lambda x: x["c"]), ",").alias("top_categories"))
    return hours.groupBy("day", "hour").agg(F.count_distinct("_u").alias("n_users")).join(top, ["day", "hour"])


def anonymous_buckets(visits: DataFrame, user: str, category: str, ts: str, k: int) -> DataFrame:
    """Days and categories with at least k distinct users."""
    buckets = visits.groupBy(F.to_date(ts).alias("day"), F.col(category).alias("category")).agg(F.count_distinct(user).alias("n_users"), F.count("*").alias("n_rows"))
    return buckets.where(F.col("n_users") >= k)


def event_impact(visits: DataFrame, category: str, ts: str, start: str, end: str, days: int) -> DataFrame:
    """Rows of each category before, during and after a window, and the ratio of the rates during and before."""
    day, first, last = F.to_date(ts), F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = {"before": (day >= F.date_sub(first, days)) & (day < first), "during": (day >= first) & (day <= last), "after": (day > last) & (day <= F.date_add(last, days))}
    sums = visits.groupBy(F.col(category).alias("category")).agg(*(F.count_if(c).alias(f"n_{m}") for m, c in inside.items()))
    length = F.date_diff(last, first) + 1
    return sums.withColumn("ratio", F.round(F.try_divide(F.col("n_during") / length, F.col("n_before") / days), 6))

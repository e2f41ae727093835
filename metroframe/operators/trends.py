"""Change over time: recent days against a baseline, scores of days, differences in differences, trends and back tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import is_night


def daily_activity(events: DataFrame, user: str, ts: str) -> DataFrame:
    """Events, distinct users and the share between 22 and 6 o'clock of each day."""
    night = is_night(F.col(ts)).cast("double")
    return events.groupBy(F.to_date(ts).alias("ds")).agg(F.count("*").alias("n_events"), F.count_distinct(user).alias("n_users"), F.round(F.avg(night), 6).alias("night_ratio"))


def hourly_share(events: DataFrame, category: str, ts: str) -> DataFrame:
    """Events of each hour of the day, and their share of the category's."""
    counted = events.groupBy(F.col(category).alias("category"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("category")), 6))


def recent_against_baseline(events: DataFrame, category: str, ts: str, recent: int, baseline: int) -> DataFrame:
    """Mean events per calendar day over the last days of the table and the days before those, and the change in percent (null without a baseline)."""
    day = F.to_date(ts)
    last = events.agg(F.max(day).alias("_last"))
    age = F.date_diff("_last", "_day")
    counted = events.groupBy(F.col(category).alias("category"), day.alias("_day")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(last))
    sums = counted.groupBy("category").agg(
        F.round(F.sum(F.when(age < recent, F.col("n")).otherwise(0)) / recent, 6).alias("recent_mean"),
        F.round(F.sum(F.when((age >= recent) & (age < recent + baseline), F.col("n")).otherwise(0)) / baseline, 6).alias("baseline_mean"),
    )
    return sums.withColumn("change_percent", F.round(F.try_divide(100 * (F.col("recent_mean") - F.col("baseline_mean")), F.col("baseline_mean")), 4))


def day_scores(series: DataFrame, spike: float, mild: float) -> DataFrame:
    """Each day's distance from the series' mean in population deviations, and its name; 0 for constant series."""
    stats = series.groupBy("unique_id").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    scored = series.join(stats, "unique_id").withColumn("z", F.when(F.col("s") > 0, F.round((F.col("y") - F.col("m")) / F.col("s"), 4)).otherwise(0.0))
    tag = F.when(F.col("z") >= spike, "spike").when(F.col("z") >= mild, "mild").when(F.col("z") <= -mild, "drop").otherwise("usual")
    return scored.select("unique_id", "ds", "y", "z", tag.alias("tag"))


def robust_scores(series: DataFrame, bound: float) -> DataFrame:
    """Days whose distance from the median, in scaled median absolute deviations, is over the bound; series with no deviation have none."""
    median = series.groupBy("unique_id").agg(F.percentile("y", F.lit(0.5)).alias("med"))
    off = series.join(median, "unique_id")
    mad = off.groupBy("unique_id").agg(F.percentile(F.abs(F.col("y") - F.col("med")), F.lit(0.5)).alias("mad"))
    scored = off.join(mad, "unique_id").where("mad > 0").withColumn("score", F.round(0.6745 * (F.col("y") - F.col("med")) / F.col("mad"), 4))
    return scored.where(F.abs("score") > bound).select("unique_id", "ds", "y", "score")


def difference_in_differences(series: DataFrame, treated: str, day: str) -> DataFrame:
    """Means before and from the day, their difference and Welch's t for each series, and the treated one's difference less the mean of the others'."""
    after = F.col("ds") >= F.lit(day).cast("date")
    pre, post = F.when(~after, F.col("y")), F.when(after, F.col("y"))
    stats = series.groupBy("unique_id").agg(
        F.avg(pre).alias("pre"), F.avg(post).alias("post"), F.var_samp(pre).alias("v0"), F.var_samp(post).alias("v1"), F.count(pre).alias("n0"), F.count(post).alias("n1")
    )
    change = F.col("post") - F.col("pre")
    is_treated = F.col("unique_id") == treated
    effect = stats.agg((F.avg(F.when(is_treated, change)) - F.avg(F.when(~is_treated, change))).alias("_effect"))
    t = F.try_divide(change, F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")))
    return stats.crossJoin(F.broadcast(effect)).select(
        "unique_id", F.round("pre", 6).alias("pre_mean"), F.round("post", 6).alias("post_mean"), F.round(change, 6).alias("change"), F.round(t, 4).alias("t"), F.round("_effect", 6).alias("effect")
    )


def trend_forecast(series: DataFrame, k: int) -> DataFrame:
    """The next day from the last k: their mean plus their mean step, with their population deviation as its band."""
    order = Window.partitionBy("unique_id").orderBy("ds")
    back = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    steps = series.withColumn("step", F.col("y") - F.lag("y").over(order)).withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= k)
    return steps.groupBy("unique_id").agg(
        F.date_add(F.max("ds"), 1).alias("ds"),
        F.round(F.avg("y") + F.avg(F.when(F.col("_r") < k, F.col("step"))), 6).alias("forecast"),
        F.round(F.stddev_pop("y"), 6).alias("band"),
    )


def seasonal_backtest(series: DataFrame, season: int, held_out: int) -> DataFrame:
    """sMAPE in percent over the last days, each forecast by the day one season before; days where both are 0 don't count."""
    last = series.groupBy("unique_id").agg(F.max("ds").alias("last"))
    before = series.select("unique_id", F.date_add("ds", season).alias("ds"), F.col("y").alias("f"))
    tested = series.join(last, "unique_id").where(F.date_diff("last", "ds") < held_out).join(before, ["unique_id", "ds"])
    error = F.try_divide(200.0 * F.abs(F.col("y") - F.col("f")), F.abs("y") + F.abs("f"))
    return tested.groupBy("unique_id").agg(F.round(F.avg(error), 6).alias("smape"), F.count(error).alias("n_days"))


def linear_trend(series: DataFrame) -> DataFrame:
    """Slope per day, value at the first day, and correlation with time of each series."""
    first = series.groupBy("unique_id").agg(F.min("ds").alias("first"))
    at = series.join(first, "unique_id").withColumn("x", F.date_diff("ds", "first").cast("double")).withColumn("y", F.col("y").cast("double"))
    return at.groupBy("unique_id").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("level"), F.round(F.corr("y", "x"), 6).alias("r"))


def entropy(events: DataFrame, key: str, over: str) -> DataFrame:
    """Entropy in bits of how each key's rows are spread over the values of another column."""
    counted = events.groupBy(key, over).agg(F.count("*").alias("n"))
    sums = counted.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("bits"))

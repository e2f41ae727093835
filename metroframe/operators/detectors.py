"""Detectors of anomalies in series (unique_id, ds, y), each a boolean column, their union and a report.

A detector compares a measure of each point with its series' quartiles: more than c times their distance outside of them is an anomaly. Points for which a window is not full,
and series whose measure has no value, have none. Windows and quartiles are by series; a series has a row per day, so the number of days bounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window():
    return Window.partitionBy("unique_id").orderBy("ds")


def _full(value: Column, first: int, last: int) -> Column:
    """value over the rows from first to last, null where they are not all there."""
    w = _window().rowsBetween(first, last)
    return F.when(F.count("y").over(w) == last - first + 1, value.over(w))


def _outside(series: DataFrame, measure: Column, name: str, c: float, both: bool) -> DataFrame:
    """Adds the boolean column name."""
    measured = series.withColumn("_m", F.round(measure, 6))
    quartiles = F.percentile("_m", F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy("unique_id"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    above = F.col("_m") > F.round(high + c * (high - low), 6)
    hit = above | (F.col("_m") < F.round(low - c * (high - low), 6)) if both else above
    return measured.withColumn("_q", quartiles).withColumn(name, F.coalesce(hit, F.lit(False))).drop("_m", "_q")


def persist(series: DataFrame, window: int = 3, c: float = 3.0) -> DataFrame:
    """A point far from the median of those just before it."""
    return _outside(series, F.col("y") - _full(F.percentile("y", F.lit(0.5)), -window, -1), "persist", c, True)


def level_shift(series: DataFrame, window: int = 6, c: float = 6.0) -> DataFrame:
    """The median from a point on is far from that before it."""
    middle = F.percentile("y", F.lit(0.5))
    return _outside(series, F.abs(_full(middle, 0, window - 1) - _full(middle, -window, -1)), "level_shift", c, False)


def volatility_shift(series: DataFrame, window: int = 6, c: float = 6.0) -> DataFrame:
    """The deviation from a point on differs much, in shares of that before it; none where that is 0."""
    spread = F.stddev_samp("y")
    before, after = _full(spread, -window, -1), _full(spread, 0, window - 1)
    return _outside(series, F.abs(after - before) / F.when(before > 0, before), "volatility_shift", c, False)


def seasonal(series: DataFrame, period: int = 7, c: float = 3.0) -> DataFrame:
    """A point far from the mean of its place in the season, counted in rows from the first."""
    placed = series.withColumn("_place", (F.row_number().over(_window()) - 1) % period)
    return _outside(placed, F.col("y") - F.avg("y").over(Window.partitionBy("unique_id", "_place")), "seasonal", c, True).drop("_place")


def threshold(series: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """A point below low or above high."""
    hits = [F.col("y") < low] if low is not None else []
    hits += [F.col("y") > high] if high is not None else []
    if not hits:
        raise ValueError("threshold needs a low or a high")
    hit = hits[0] | hits[1] if len(hits) == 2 else hits[0]
    return series.withColumn("threshold", F.coalesce(hit, F.lit(False)))


def report(detected: DataFrame, names: list[str], first: int) -> DataFrame:
    """For each series its points, those that a detector names, their share, how many each names, and the days of the first ones."""
    hit = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    rows = detected.withColumn("_hit", hit)
    place = F.when(F.col("_hit"), F.sum(F.col("_hit").cast("int")).over(_window()))
    days = F.array_sort(F.collect_list(F.when(F.col("_place") <= first, F.date_format("ds", "yyyy-MM-dd"))))
    return rows.withColumn("_place", place).groupBy("unique_id").agg(
        F.count("*").alias("points"), F.count_if("_hit").alias("anomalies"), F.round(F.count_if("_hit") / F.count("*"), 6).alias("rate"),
        *(F.count_if(n).alias(f"n_{n}") for n in names), F.array_join(days, ",").alias("first_days"),
    )


def best_model(errors: DataFrame) -> DataFrame:
    """The model with the least mean symmetric percentage error for each series, ties by name, from rows (unique_id, model, y, forecast); points at which both are 0 have none."""
    size = F.abs("y") + F.abs("forecast")
    part = F.when(size > 0, 2.0 * F.abs(F.col("y") - F.col("forecast")) / size).otherwise(0.0)
    scored = errors.groupBy("unique_id", "model").agg(F.round(F.avg(part) * 100, 6).alias("smape"))
    return scored.groupBy("unique_id").agg(F.min(F.struct("smape", "model")).alias("_b")).select("unique_id", "_b.model", "_b.smape")

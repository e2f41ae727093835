"""Column profiles: one aggregation for all columns, then one row per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max and nulls of each column, rounded to six places."""
    measures = {
        "n": lambda c: F.count(c).cast("double"),
        "mean": F.avg,
        "deviation": F.stddev_samp,
        "least": lambda c: F.min(c).cast("double"),
        "most": lambda c: F.max(c).cast("double"),
        "nulls": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
    }
    order = ("n", "mean", "deviation", "least", "q25", "median", "q75", "most", "nulls")
    rows = []
    quarters = ranks.quantile_table(df, columns, [[0.25, 0.5, 0.75]] * len(columns))
    for c, own in zip(columns, quarters):
        made = {m: F.round(f(c), 6) for m, f in measures.items()}
        made |= {m: F.round(F.lit(v).cast("double"), 6) for m, v in zip(("q25", "median", "q75"), own)}
        rows.append(F.struct(F.lit(c).alias("column_name"), *(made[m].alias(m) for m in order)).alias(c))
    return df.agg(*rows).select(F.explode(F.array(*(f"`{c}`" for c in columns))).alias("p")).select("p.*")


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, distinct values, the most frequent value (the least of ties) and nulls of each column."""
    values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")).select("v.*")
    counted = values.groupBy("column_name", "value").agg(F.count("*").alias("times"))
    known = F.col("value").isNotNull()
    return counted.groupBy("column_name").agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("n"),
        F.count_if(known).alias("n_distinct"),
        F.min_by("value", F.when(known, F.struct((-F.col("times")).alias("a"), F.col("value").alias("b")))).alias("mode"),
        F.sum(F.when(known, 0).otherwise(F.col("times"))).alias("nulls"),
    )


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values with their share of the rows that have one."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("times"))
    total = counted.agg(F.sum("times").alias("total"))
    return counted.orderBy(F.desc("times"), "value").limit(k).crossJoin(F.broadcast(total)).select("value", "times", F.round(100.0 * F.col("times") / F.col("total"), 2).alias("percent"))


def share_within(df: DataFrame, outer: str, inner: str, key: str) -> DataFrame:
    """Distinct keys of each (outer, inner) and their share of all those in outer."""
    counted = df.groupBy(outer, inner).agg(F.count_distinct(key).alias("n_keys"))
    return counted.withColumn("share", F.round(F.col("n_keys") / F.sum("n_keys").over(Window.partitionBy(outer)), 6))

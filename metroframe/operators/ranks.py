"""Exact ranks and quantiles without one task that sees all values.

Values are counted first, so equal ones are one row. The different values are dealt into ranges; each range's number of rows
is added up, which is one row per range, and a value's rank is its range's offset plus its place in the range."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


#: Different values of all columns, up to which ranks go out to all tasks instead of meeting the rows in a shuffle.
FEW = 200_000


def placed(df: DataFrame, columns: list[str | Column]) -> DataFrame:
    """Each different value of each column (column: its place in the list, value, n, before: rows of the column with a less one). Nulls are no values.

    All columns at once: rows are counted by column and value, and the counts are dealt into ranges of both."""
    spark = df.sparkSession
    each = F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value") if isinstance(c, str) else c.cast("double").alias("value")) for i, c in enumerate(columns)))
    counted = df.select(F.explode(each).alias("v")).select("v.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    dealt = cut(spark, counted.repartitionByRange("column", "value").withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("column", "range").agg(F.sum("n").alias("size"))  # a row for each range and column in it
    starts = sizes.select("column", "range", (F.sum("size").over(Window.partitionBy("column").orderBy("range")) - F.col("size")).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("column", "range").orderBy("value")) - F.col("n")
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), ["column", "range"]).select("column", "value", "n", (F.col("start") + F.col("inside")).alias("before"))


def quantile_table(df: DataFrame, columns: list[str], shares: list[list[float]]) -> list[list[float | None]]:
    """For each column its quantiles, with linear interpolation between neighbours; null for a column without values."""
    at = placed(df, columns)
    totals = {r["column"]: r["n"] for r in at.groupBy("column").agg(F.sum("n").alias("n")).collect()}  # a row for each column
    wanted = sorted({(c, r) for c, qs in enumerate(shares) for q in qs if c in totals for r in (math.floor((totals[c] - 1) * q), math.ceil((totals[c] - 1) * q))})
    pick = [F.max(F.when((F.col("column") == c) & (F.col("before") <= r) & (F.col("before") + F.col("n") > r), F.col("value"))).alias(f"c{c}_{r}") for c, r in wanted]
    row = at.agg(*pick).first() if pick else None
    out = []
    for c, qs in enumerate(shares):
        places = [(totals[c] - 1) * q for q in qs] if c in totals else []
        ends = [(row[f"c{c}_{math.floor(x)}"], row[f"c{c}_{math.ceil(x)}"], x - math.floor(x)) for x in places]
        out.append([low + (high - low) * part for low, high, part in ends] if c in totals else [None] * len(qs))
    return out


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles of one column."""
    return quantile_table(df, [column], [shares])[0]


def percent_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with, for each {column: new name}, the mean rank of equal values over the number of rows; nulls count as 0; all 0 for a column with one value.

    The different values' ranks go out to all tasks if they are few, else each column's meet the rows by value."""
    spark = df.sparkSession
    rows = cut(spark, df)
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    at = placed(rows, values)
    totals = at.groupBy("column").agg(F.sum("n").alias("all"), F.count("*").alias("values"))
    share = F.when(F.col("values") == 1, 0.0).otherwise((F.col("before") + (F.col("n") + 1) / 2) / F.col("all"))
    shares = at.join(F.broadcast(totals), "column").select("column", "value", share.alias("share"))
    few = sum(r["values"] for r in totals.collect()) <= FEW
    out, mark = rows, uuid.uuid4().hex[:8]
    for i, (value, name) in enumerate(zip(values, columns.values())):
        own = shares.where(F.col("column") == i).select(F.col("value").alias(f"{mark}_value"), F.col("share").alias(f"{mark}_share"))
        found = out.join(F.broadcast(own) if few else own, value == F.col(f"{mark}_value"))
        out = found.withColumn(name, F.col(f"{mark}_share")).drop(f"{mark}_value", f"{mark}_share")
    return out

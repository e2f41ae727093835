"""Filters over properties, conditions with thresholds taken from the data, and what each of them lets through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks

OPS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "IN": lambda c, v: c.isin(*v),
    "CONTAINS": lambda c, v: c.contains(v),
    "STARTS WITH": lambda c, v: c.startswith(v),
}


def property_filter(df: DataFrame, conditions: list[tuple]) -> DataFrame:
    """Rows for which all (column, operator, value) hold; all rows without conditions."""
    return df.where(reduce(lambda a, b: a & b, (OPS[op](F.col(c), v) for c, op, v in conditions), F.lit(True)))


def condition_matches(df: DataFrame, key: str, conditions: dict[str, tuple[str, float]]) -> DataFrame:
    """match_<name> for each {name: (column, quantile)}: the value is at least that quantile of its column (null: false); and how many match."""
    flags = df
    names = []
    limits = ranks.quantile_table(df, [c for c, _ in conditions.values()], [[q] for _, q in conditions.values()])
    for (n, (c, _)), (limit,) in zip(conditions.items(), limits):
        flags = flags.withColumn(f"match_{n}", F.coalesce(F.col(c) >= F.round(F.lit(limit).cast("double"), 6), F.lit(False)))
        names.append(f"match_{n}")
    return flags.select(key, *names).withColumn("hits", sum(F.col(n).cast("int") for n in names))


def condition_audit(matches: DataFrame, names: list[str]) -> DataFrame:
    """Rows left after each condition in turn, and rows that match it alone, from one pass."""
    so_far, rows = F.lit(True), []
    for i, n in enumerate(names):
        so_far = so_far & F.col(f"match_{n}")
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("condition"), F.count_if(so_far).alias("survivors"), F.count_if(F.col(f"match_{n}")).alias("matches")))
    return matches.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def levels(df: DataFrame, column: str, steps: dict[float, str], rest: str) -> DataFrame:
    """level: the name of the highest quantile that the value reaches."""
    named = sorted(steps.items(), reverse=True)
    limits = ranks.quantiles(df, column, [q for q, _ in named])
    level = F.lit(rest)
    for (_, name), limit in reversed(list(zip(named, limits))):
        level = F.when(F.col(column) >= F.round(F.lit(limit).cast("double"), 6), F.lit(name)).otherwise(level)
    return df.withColumn("level", level)

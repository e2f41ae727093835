"""Searches by time, place and words, lookups, masks of conditions, paging."""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, geo
from . import ranks


def record_text(columns: list[str]) -> Column:
    """All values of a row as lower-case text, nulls left out."""
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))


def in_time(ts: Column, start: str | None = None, end: str | None = None, hours: tuple[int, int] | None = None, missing: bool = False) -> Column:
    """From start to end, both included, and within hours [from, to), over midnight if from is later. missing: what a row without time counts as, if anything is asked."""
    asked = [ts >= F.lit(start).cast("timestamp_ntz")] if start else []
    asked += [ts <= F.lit(end).cast("timestamp_ntz")] if end else []
    asked += [calendar.in_hours(F.hour(ts), *hours)] if hours else []
    return F.coalesce(reduce(lambda a, b: a & b, asked), F.lit(missing)) if asked else F.lit(True)


def spatiotemporal(df: DataFrame, ts: str, lat: str, lon: str, words: str = "", cell: str | None = None, prefix: str = "", start=None, end=None, hours=None, box=None, text_columns: list[str] | None = None) -> DataFrame:
    """Rows that have all words in their text, a cell that begins with prefix, a time and a place as asked. A row without time or place fails what is asked of it."""
    text = record_text(text_columns or df.columns)
    keep = in_time(F.col(ts), start, end, hours)
    for word in words.lower().split():
        keep = keep & text.contains(word)
    if prefix:
        keep = keep & F.coalesce(F.col(cell).startswith(prefix), F.lit(False))
    if box:
        keep = keep & geo.in_box(F.col(lat), F.col(lon), box)
    return df.where(keep)


def scored(df: DataFrame, score: Column, key: str, ts: str, lat: str, lon: str, start=None, end=None, hours=None, box=None, k: int = 20) -> DataFrame:
    """The other search: a row without time or place passes, and the rows of highest score (over 0) come first, ties by key."""
    keep = in_time(F.col(ts), start, end, hours, missing=True)
    if box:
        keep = keep & (geo.in_box(F.col(lat), F.col(lon), box) | F.col(lat).isNull() | F.col(lon).isNull())
    return df.where(keep).withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def first_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first rows in the input's order, which its columns give."""
    return df.orderBy(*order).limit(k)


def within_distance(df: DataFrame, lat: str, lon: str, centre: tuple[float, float], km: float) -> DataFrame:
    """Rows at most so far from a place. A box around it comes first, which the scan can prune by."""
    d_lat = km / 110.5
    near = F.col(lat).between(centre[0] - d_lat, centre[0] + d_lat)
    distance = geo.haversine_km(F.col(lat), F.col(lon), F.lit(centre[0]), F.lit(centre[1]))
    return df.where(near).withColumn("distance_km", distance).where(F.col("distance_km") <= km).withColumn("distance_km", F.round("distance_km", 6))


def conditions(df: DataFrame, key: str, asked: dict[str, Column]) -> DataFrame:
    """match_<name> for each condition, null as false, hits (how many hold), and whether all or any hold; without conditions all rows match."""
    flags = df.select(key, *(F.coalesce(c, F.lit(False)).alias(f"match_{n}") for n, c in asked.items()))
    names = [F.col(f"match_{n}") for n in asked]
    hits = sum((n.cast("int") for n in names), F.lit(0))
    return flags.withColumns({"hits": hits, "all_match": hits == len(names), "any_match": (hits > 0) | F.lit(not names)})


def audit(matches: DataFrame, names: list[str], mode: str) -> DataFrame:
    """all: rows left after each condition in turn. any: rows that meet each condition, and at last those that meet one. One pass."""
    so_far, rows = F.lit(mode == "all"), []
    for i, n in enumerate(names):
        flag = F.col(f"match_{n}")
        so_far = so_far & flag if mode == "all" else so_far | flag
        rows.append(F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("condition"), F.count_if(so_far if mode == "all" else flag).alias("survivors")))
    if mode == "any":
        rows.append(F.struct(F.lit(len(names) + 1).alias("step"), F.lit("any").alias("condition"), F.count_if(so_far).alias("survivors")))
    return matches.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def upper_threshold(df: DataFrame, column: str, quantile: float, floor: float) -> DataFrame:
    """The quantile rounded up, but at least floor: one row; floor without values."""
    (found,) = ranks.quantiles(df, column, [quantile])
    return df.sparkSession.range(1).select(F.greatest(F.lit(float(floor)), F.lit(float(floor if found is None else math.ceil(found)))).alias("threshold"))


def faceted(df: DataFrame, words: str, weights: dict[str, float], terms: dict[str, str], dates: tuple[str, str, str], newest: str, key: str, page: int, size: int) -> DataFrame:
    """Rows with a word in a weighted field, the terms asked and a date in a range, scored by the weights of fields that hit; newest first among equals; one page."""
    asked = words.lower().split()
    score = sum((F.when(F.lower(F.coalesce(c, F.lit(""))).contains(w), weight).otherwise(0.0) for c, weight in weights.items() for w in asked), F.lit(0.0))
    column, start, end = dates
    keep = F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    for c, v in terms.items():
        keep = keep & (F.col(c) == v)
    found = df.where(keep).withColumn("score", F.round(score, 4)).where("score > 0")
    return found.orderBy(F.desc("score"), F.desc(newest), key).offset((page - 1) * size).limit(size)


def like_any(df: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows with the word in one of the columns, in any case."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(word.lower()), F.lit(False)) for c in columns)))


def visible(df: DataFrame, workspace: str) -> DataFrame:
    """What is ready and current, and either everybody's (no workspace) or of this workspace."""
    return df.where((F.col("status") == "ready") & F.col("is_current") & (F.col("workspace").isNull() | (F.col("workspace") == workspace)))


def with_landmarks(df: DataFrame, landmarks: DataFrame, city: str, cell: str, prefix: int) -> DataFrame:
    """A landmark by city and cell; where there is none, the first one by name of those in the same city whose cell begins alike. The gazetteer may have any size."""
    one, two = df.alias("one"), uuid.uuid4().hex[:8]
    known = landmarks.select(F.col(city).alias(f"{two}_a"), F.col(cell).alias(f"{two}_b"), F.col("landmark").alias(f"{two}_exact"))
    near = landmarks.groupBy(F.col(city).alias(f"{two}_c"), F.substring(cell, 1, prefix).alias(f"{two}_d")).agg(F.min("landmark").alias(f"{two}_near"))
    found = one.join(known, (F.col(f"one.{city}") == F.col(f"{two}_a")) & (F.col(f"one.{cell}") == F.col(f"{two}_b")), "left")
    found = found.join(near, (F.col(f"one.{city}") == F.col(f"{two}_c")) & (F.substring(F.col(f"one.{cell}"), 1, prefix) == F.col(f"{two}_d")), "left")
    return found.select(*(F.col(f"one.{c}") for c in df.columns), F.coalesce(f"{two}_exact", f"{two}_near").alias("landmark"))


def compact(df: DataFrame, vectors: list[str], text: int = 300, items: int = 20) -> DataFrame:
    """For a preview: no vectors, text of at most so many characters, lists of at most so many items."""
    out = []
    for name, kind in df.dtypes:
        if name not in vectors:
            c = F.col(name)
            out.append((F.substring(c, 1, text) if kind == "string" else F.slice(c, 1, items) if kind.startswith("array") else c).alias(name))
    return df.select(*out)

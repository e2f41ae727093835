"""Points, trips and cells of subjects that move: cleaning, flows, evidence, impact, anomalies, likeness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, geo


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def once(points: DataFrame, user: str, ts: str, lat: str, lon: str, order: str) -> DataFrame:
    """Valid points (with user, time and a place on earth), one of each (user, time, place rounded to seven digits): the first in order."""
    valid = points.where(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    w = Window.partitionBy(user, ts, F.round(lat, 7), F.round(lon, 7)).orderBy(order)
    return valid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_jumps(points: DataFrame, user: str, ts: str, lat: str, lon: str, order: str, most_kmh: float) -> DataFrame:
    """Points that are reached from the last kept one at no more than a speed; a point that follows in no time stays.

    Each point depends on which ones before it were kept, so a user's points go in order through one pass: they come sorted, in
    batches, and only the last kept point is held, so a user may have any number."""
    schema = points.schema

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        user_now, last = object(), None
        for pdf in batches:
            keep = np.ones(len(pdf), bool)
            times = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
            for i, (u, t, a, b) in enumerate(zip(pdf[user].tolist(), times.tolist(), pdf[lat].tolist(), pdf[lon].tolist())):
                if u != user_now:
                    user_now, last = u, None
                if last is not None:
                    hours = (t - last[0]) / 3.6e9
                    half = np.sin(np.radians(a - last[1]) / 2) ** 2 + np.cos(np.radians(last[1])) * np.cos(np.radians(a)) * np.sin(np.radians(b - last[2]) / 2) ** 2
                    if hours > 0 and 2 * geo.RADIUS_KM * np.arcsin(np.sqrt(half)) / hours > most_kmh:
                        keep[i] = False
                        continue
                last = (t, a, b)
            yield pdf[keep]

    return points.repartition(user).sortWithinPartitions(user, ts, order).mapInPandas(run, schema)


STAYS = "user long, started timestamp_ntz, ended timestamp_ntz, minutes double, lat double, lon double, points long"


def stays(points: DataFrame, user: str, ts: str, lat: str, lon: str, order: str, radius_m: float, least_minutes: float) -> DataFrame:
    """Runs of points within a radius of their first one that last so long; a run that is still open at a user's end is none.

    One pass over each user's points in order, as for without_jumps; only the points of the open run are held."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def km(a, b):
            half = np.sin(np.radians(b[1] - a[1]) / 2) ** 2 + np.cos(np.radians(a[1])) * np.cos(np.radians(b[1])) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
            return 2 * geo.RADIUS_KM * np.arcsin(np.sqrt(half))

        def settled(held, out, u, ended):
            """Emit the runs among the held points that are over; what is left is the open run, or nothing once the user's points have ended."""
            i = 0
            while i < len(held):
                j = next((j for j in range(i + 1, len(held)) if km(held[i], held[j]) > radius_m / 1000), None)
                if j is None and not ended:
                    break
                minutes = (held[j - 1][0] - held[i][0]) / 6e7 if j is not None else -1.0
                if minutes >= least_minutes:
                    run = held[i:j]
                    out.append((u, run[0][0], run[-1][0], round(minutes, 3), float(np.mean([p[1] for p in run])), float(np.mean([p[2] for p in run])), len(run)))
                    i = j
                else:
                    i += 1
            return held[i:]

        def framed(out):
            frame = pd.DataFrame(out, columns=["user", "started", "ended", "minutes", "lat", "lon", "points"])
            for c in ("started", "ended"):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            return frame

        user_now, held = None, []
        for pdf in batches:
            out: list = []
            times = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
            for u, t, a, b in zip(pdf[user].tolist(), times.tolist(), pdf[lat].tolist(), pdf[lon].tolist()):
                if u != user_now:
                    settled(held, out, user_now, True)
                    user_now, held = u, []
                held.append((t, a, b))
                if km(held[0], held[-1]) > radius_m / 1000:
                    held = settled(held, out, u, False)
            yield framed(out)
        out = []
        settled(held, out, user_now, True)
        yield framed(out)

    return points.select(user, ts, lat, lon, order).repartition(user).sortWithinPartitions(user, ts, order).mapInPandas(run, STAYS)


def segmented(points: DataFrame, user: str, ts: str, lat: str, lon: str, order: str, gap_minutes: float, least_points: int) -> DataFrame:
    """Trips: runs of a user's points without a longer gap, of at least so many points: ends, points, km along the way, straight km and their ratio."""
    w = Window.partitionBy(user).orderBy(ts, order)
    begins = F.coalesce(micros(ts) - F.lag(micros(ts)).over(w) > gap_minutes * 6e7, F.lit(True))
    numbered = points.withColumn("_b", begins.cast("int")).withColumn("trip", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(user, "trip").orderBy(ts, order)
    step = geo.haversine_km(F.lag(lat).over(inside), F.lag(lon).over(inside), F.col(lat), F.col(lon))
    stepped = numbered.withColumn("_km", F.coalesce(step, F.lit(0.0)))
    place = F.struct(ts, order)
    first, last = (f(F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")), place) for f in (F.min_by, F.max_by))
    made = stepped.groupBy(user, "trip").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("points"), F.sum("_km").alias("km"), first.alias("a"), last.alias("b")).where(F.col("points") >= least_points)
    straight = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    minutes = (micros("ended") - micros("started")) / 6e7
    return made.select(user, "trip", "started", "ended", "points", "km", straight.alias("straight_km"), minutes.alias("minutes"), "a", "b")


def cell_heat(points: DataFrame, user: str, category: str, ts: str, cell: str, width: str, k: int = 5) -> DataFrame:
    """Rows, different users and the k most frequent categories of each cell and time."""
    rows = points.select(F.col(cell).alias("cell"), calendar.bucket(F.col(ts), width).alias("bucket"), F.col(user).alias("_u"), F.col(category).alias("_c"))
    by_category = rows.groupBy("cell", "bucket", "_c").agg(F.count("*").alias("n"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("_c").alias("c")))), 1, k), lambda x: x["c"])
    tops = by_category.groupBy("cell", "bucket").agg(F.sum("n").alias("n"), F.array_join(top, ",").alias("categories"))
    return rows.groupBy("cell", "bucket").agg(F.count_distinct("_u").alias("users")).join(tops, ["cell", "bucket"])


def flows(visits: DataFrame, user: str, ts: str, cell: str, lat: str, lon: str, order: str) -> DataFrame:
    """Moves between different cells: flow, users, mean hours, and the mean places of both ends."""
    w = Window.partitionBy(user).orderBy(ts, order)
    ahead = {n: F.lead(c).over(w) for n, c in {"_cell": cell, "_ts": ts, "_lat": lat, "_lon": lon}.items()}
    moves = visits.withColumns(ahead).where(F.col("_cell") != F.col(cell))
    hours = (micros("_ts") - micros(ts)) / 3.6e9
    means = {"mean_hours": hours, "from_lat": F.col(lat), "from_lon": F.col(lon), "to_lat": F.col("_lat"), "to_lon": F.col("_lon")}
    return moves.groupBy(F.col(cell).alias("origin"), F.col("_cell").alias("destination")).agg(F.count("*").alias("flow"), F.count_distinct(user).alias("users"), *(F.round(F.avg(c), 7).alias(n) for n, c in means.items()))


def private_buckets(points: DataFrame, user: str, category: str, ts: str, cell: str, k: int) -> DataFrame:
    """Days, slots of the day and cells with at least k users, with the three most frequent categories and their percent."""
    rows = points.select(F.to_date(ts).alias("day"), calendar.day_slot(F.hour(ts)).alias("slot"), F.col(cell).alias("cell"), F.col(user).alias("_u"), F.col(category).alias("_c"))
    keys = ["day", "slot", "cell"]
    users = rows.groupBy(*keys).agg(F.count_distinct("_u").alias("users"), F.count("*").alias("n")).where(F.col("users") >= k)
    counted = rows.groupBy(*keys, "_c").agg(F.count("*").alias("m"))
    top = counted.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), F.col("_c").alias("c")))), 1, 3).alias("top"))
    text = F.array_join(F.transform("top", lambda x: F.concat(x["c"], F.lit(":"), F.format_number(F.round(-100.0 * x["m"] / F.col("n"), 1), 1), F.lit("%"))), ",")
    return users.join(top, keys).select(*keys, "users", "n", text.alias("categories"))


def impact(points: DataFrame, region: str, ts: str, start: str, end: str, days: int, up: float = 1.2, down: float = 0.8) -> DataFrame:
    """Daily rows before, during and after an event, the ratio of during to before, of after to before (recovery), and what that means."""
    day, first, last = F.to_date(ts), F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = {"before": (day >= F.date_sub(first, days)) & (day < first), "during": day.between(first, last), "after": (day > last) & (day <= F.date_add(last, days))}
    sums = points.groupBy(F.col(region).alias("region")).agg(*(F.count_if(c).alias(f"n_{m}") for m, c in inside.items()))
    before = F.col("n_before") / days
    ratio = F.try_divide(F.col("n_during") / (F.date_diff(last, first) + 1), before)
    label = F.when(ratio.isNull(), "no_baseline").when(ratio >= up, "surge").when(ratio <= down, "drop").otherwise("stable")
    return sums.withColumns({"ratio": F.round(ratio, 6), "recovery": F.round(F.try_divide(F.col("n_after") / days, before), 6), "label": label})


def normal_p(t: Column) -> Column:
    """Two-sided p of a standard normal value, to seven digits (a rational approximation of the error function)."""
    x = F.abs(t) / 2**0.5
    u = 1 / (1 + 0.3275911 * x)
    return u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * F.exp(-x * x)


def effect(series: DataFrame, treated: list[str], start: str) -> DataFrame:
    """Means of each series before and from a day on, Welch's t of the change with its p, and the change less the mean change of series that weren't treated."""
    after = F.col("ds") >= F.lit(start).cast("date")
    pre, post = F.when(~after, F.col("y")), F.when(after, F.col("y"))
    stats = series.groupBy("unique_id").agg(F.avg(pre).alias("a"), F.avg(post).alias("b"), F.var_samp(pre).alias("u"), F.var_samp(post).alias("v"), F.count(pre).alias("n"), F.count(post).alias("m"))
    control = stats.where(~F.col("unique_id").isin(treated)).agg(F.avg(F.col("b") - F.col("a")).alias("c"))
    t = F.try_divide(F.col("b") - F.col("a"), F.sqrt(F.col("u") / F.col("n") + F.col("v") / F.col("m")))
    change = F.col("b") - F.col("a")
    return stats.crossJoin(F.broadcast(control)).select("unique_id", F.round("a", 6).alias("pre_mean"), F.round("b", 6).alias("post_mean"), F.round(t, 4).alias("t"), F.round(normal_p(t), 5).alias("p"), F.round(change - F.col("c"), 6).alias("effect"))


def robust(df: DataFrame, group: str, value: str) -> DataFrame:
    """score of each value in its group: 0 for one value, population deviations for fewer than five or where the median deviation is 0, else 0.6745 deviations from the median over the median deviation."""
    known = df.where(F.col(value).isNotNull())
    stats = known.groupBy(group).agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"), F.percentile(value, F.lit(0.5)).alias("_median"))
    joined = known.join(stats, group)
    spread = joined.groupBy(group).agg(F.percentile(F.abs(F.col(value) - F.col("_median")), F.lit(0.5)).alias("_mad"))
    usual = F.coalesce(F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd")), F.lit(0.0))
    score = F.when(F.col("_n") < 2, 0.0).when((F.col("_n") < 5) | (F.col("_mad") == 0), usual).otherwise(F.try_divide(0.6745 * (F.col(value) - F.col("_median")), F.col("_mad")))
    return joined.join(spread, group).withColumn("score", score).drop("_n", "_mean", "_sd", "_median", "_mad")


def anomalies(df: DataFrame, group: str, key: str, measures: list[str], bound: float, k: int) -> DataFrame:
    """The k values furthest out in their group, over all measures: measure, value, score and on which side."""
    found = None
    for m in measures:
        rows = robust(df.select(group, key, F.col(m).cast("double").alias("value")), group, "value").where(F.abs("score") >= bound)
        rows = rows.select(group, key, F.lit(m).alias("measure"), F.round("value", 4).alias("value"), F.round(F.abs("score"), 4).alias("score"), F.when(F.col("score") > 0, "high").otherwise("low").alias("side"))
        found = rows if found is None else found.union(rows)
    return found.orderBy(F.desc("score"), key, "measure").limit(k)


def alike(trips: DataFrame, key: str, target, columns: list[str], k: int) -> DataFrame:
    """The k trips nearest to one: columns in population deviations (1 for a constant one), 1 / (1 + distance)."""
    stats = trips.agg(*(F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"_s_{c}") for c in columns))
    one = trips.where(F.col(key) == target).limit(1).select(*(F.col(c).alias(f"_t_{c}") for c in columns))
    distance = F.sqrt(sum(F.pow((F.col(c) - F.col(f"_t_{c}")) / F.col(f"_s_{c}"), F.lit(2.0)) for c in columns))
    scored = trips.where(F.col(key) != target).crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(one))
    return scored.select(key, F.round(1 / (1 + distance), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def fused(evidence: DataFrame, region: str, ts: str, score: str, source: str, label: str, width: str) -> DataFrame:
    """Evidence of each region and time: sum of log1p(score), greatest score, rows, all sources with their counts, and the three most frequent labels."""
    rows = evidence.select(F.col(region).alias("region"), calendar.bucket(F.col(ts), width).alias("bucket"), F.col(score).alias("s"), F.col(source).alias("f"), F.col(label).alias("l"))
    keys = ["region", "bucket"]

    def tops(c: str, k: int | None) -> DataFrame:
        counted = rows.groupBy(*keys, c).agg(F.count("*").alias("n"))
        order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(c).cast("string").alias("v"))))
        order = order if k is None else F.slice(order, 1, k)
        return counted.groupBy(*keys).agg(F.array_join(F.transform(order, lambda x: F.concat(x["v"], F.lit("="), (-x["n"]).cast("string"))), ",").alias(f"{c}_counts"))

    sums = rows.groupBy(*keys).agg(F.round(F.sum(F.log1p(F.greatest("s", F.lit(0.0)))), 4).alias("fused"), F.max("s").alias("top"), F.count("*").alias("n"))
    return sums.join(tops("f", None), keys).join(tops("l", 3), keys)


def movement_state(points: DataFrame, user: str, ts: str, lat: str, lon: str, order: str, cell: str) -> DataFrame:
    """How each user moves: path, straight and widest distance (between corners of the box around all points), share of the most visited cell, and a name for it."""
    w = Window.partitionBy(user).orderBy(ts, order)
    step = geo.haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    rows = points.withColumn("_km", F.coalesce(step, F.lit(0.0)))
    place, spot = F.struct(ts, order), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    own = rows.groupBy(user).agg(
        F.count("*").alias("points"), F.sum("_km").alias("km"), F.min_by(spot, place).alias("a"), F.max_by(spot, place).alias("b"), F.min(lat).alias("s"), F.max(lat).alias("n"), F.min(lon).alias("w"), F.max(lon).alias("e")
    )
    cells = points.groupBy(user, cell).agg(F.count("*").alias("m")).groupBy(user).agg(F.count("*").alias("cells"), F.max("m").alias("most"))
    made = own.join(cells, user).withColumns({"net_km": geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), "span_km": geo.haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("e"))})
    direct = F.coalesce(F.try_divide(F.col("net_km"), F.col("km")), F.lit(0.0))
    share = F.col("most") / F.col("points")
    state = (
        F.when(F.col("points") < 2, "insufficient_data").when((share >= 0.9) | (F.col("span_km") < 0.2), "stationary").when((direct >= 0.7) & (F.col("span_km") >= 3), "directed_migration")
        .when((F.col("cells") >= 5) & (direct < 0.3), "frequent_circulation").otherwise("random_walk")
    )
    return made.select(user, "points", F.round("km", 3).alias("km"), F.round("net_km", 3).alias("net_km"), F.round(direct, 3).alias("directness"), "cells", F.round(share, 3).alias("top_share"), state.alias("state"))

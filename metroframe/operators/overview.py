"""Overviews of tables, of calls and of devices; what a group has in common; checks of quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import is_night
from . import ranks
from .risk import device_edges


def node_overview(nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows, different keys and repeated rows, and rows and share of each value of the columns (measure, value, n, share)."""
    per_key = nodes.groupBy(key).agg(F.count("*").alias("n"))
    totals = per_key.agg(F.sum("n").alias("rows"), F.count(key).alias("distinct"), F.sum(F.col("n") - 1).alias("duplicates"))
    one = totals.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.lit("").alias("value"), F.col(m).alias("n")) for m in ("rows", "distinct", "duplicates")))).alias("r")).select("r.*")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns))).alias("r")
    counted = nodes.select(values).groupBy("r.measure", "r.value").agg(F.count("*").alias("n"))
    return one.union(counted).crossJoin(F.broadcast(totals.select("rows"))).select("measure", "value", "n", F.round(F.try_divide(F.col("n"), F.col("rows")), 6).alias("share"))


def call_overview(calls: DataFrame) -> DataFrame:
    """Records, weight, different ends, first and last time, the share of nights, and the share of calendar days with calls: one row."""
    day = F.to_date("ts")
    return calls.agg(
        F.count("*").alias("records"), F.sum("duration").alias("weight"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.round(F.avg(is_night(F.col("ts")).cast("double")), 6).alias("night_ratio"), F.round(F.count_distinct(day) / (F.date_diff(F.max(day), F.min(day)) + 1), 6).alias("active_ratio"),
    )


def top_ends(calls: DataFrame, end: str, other: str, k: int) -> DataFrame:
    """The k ends with most records, ties by number."""
    own = calls.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("records"), F.sum("duration").alias("weight"), F.count_distinct(other).alias("others"), F.round(F.avg(is_night(F.col("ts")).cast("double")), 6).alias("night_ratio"))
    return own.orderBy(F.desc("records"), "id").limit(k)


def top_devices(calls: DataFrame, subjects: DataFrame, risk: Column, k: int) -> DataFrame:
    """The k devices with most users: users, risky ones, and the numbers of the first ten."""
    used = calls.select("src", "device").distinct().join(subjects.select(F.col("id").alias("src"), risk.alias("_risk")), "src", "left")
    stats = used.groupBy("device").agg(F.count("*").alias("users"), F.count_if("_risk").alias("risky")).orderBy(F.desc("users"), "device").limit(k)
    # Only the devices that are shown have their users listed, and of these ten.
    w = Window.partitionBy("device").orderBy("src")
    listed = used.join(F.broadcast(stats.select("device")), "device", "left_semi").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return stats.join(listed.groupBy("device").agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ", ").alias("first_users")), "device")


def item_artifact(calls: DataFrame, members: DataFrame, subjects: DataFrame, item: str, risk: Column, least: int) -> DataFrame:
    """Items (devices or counterparts) that at least so many members have: members, all users, risky ones, provinces and the first five members."""
    used = calls.select("src", item).distinct().join(subjects.select(F.col("id").alias("src"), "province", risk.alias("_risk")), "src", "left")
    flagged = used.join(members.select(F.col("id").alias("src"), F.lit(True).alias("_own")), "src", "left")
    stats = flagged.groupBy(item).agg(F.count_if("_own").alias("members"), F.count("*").alias("users"), F.count_if("_risk").alias("risky"), F.array_join(F.array_sort(F.collect_set("province")), ", ").alias("provinces")).where(F.col("members") >= least)
    w = Window.partitionBy(item).orderBy("src")
    first = flagged.where("_own").withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ", ").alias("preview"))
    return stats.join(first, item)


def expansion(calls: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Other subjects on the seeds' devices, by different devices in common; the first k, ties by number."""
    one = calls.select("src", "device").distinct()
    held = one.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select("device").distinct()
    found = one.join(held, "device", "left_semi").join(seeds.select(F.col("id").alias("src")), "src", "left_anti")
    return found.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("shared_devices")).orderBy(F.desc("shared_devices"), "id").limit(k)


def trimmed_circle(candidates: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """All seeds, and of the others those with the greatest 10 * devices + 3 * counterparts, so that at most `most` are left."""
    n = seeds.count()
    rest = candidates.join(seeds.select("id"), "id", "left_anti").orderBy(F.desc(10 * F.col("devices") + 3 * F.col("counterparts")), "id").limit(max(0, most - n))
    return seeds.select("id", F.lit(True).alias("is_seed")).union(rest.select("id", F.lit(False)))


def group_calls(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Of each member: records, different counterparts, and those within the group."""
    ids = members.select("id")
    marked = calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_in")), "dst", "left")
    inside = F.when(F.col("_in"), F.col("dst"))
    return marked.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("records"), F.count_distinct("dst").alias("counterparts"), F.count("_in").alias("internal_calls"), F.count_distinct(inside).alias("internal_counterparts"))


def group_devices(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Of each member: devices, those that others use, with at least 3, 5 and 10 users, those of other members, other members on them, the largest pool, and peers in all."""
    edges = device_edges(calls)
    own = edges.join(members.select(F.col("id").alias("src")), "src", "left_semi")
    inside = own.groupBy("device").agg(F.count("*").alias("k"))
    joined = own.join(inside, "device")
    at = lambda c, n: F.count_if(F.col(c) >= n)
    return joined.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("devices"), at("users", 2).alias("shared"), at("users", 3).alias("pools_3"), at("users", 5).alias("pools_5"), at("users", 10).alias("pools_10"), at("k", 2).alias("in_group"),
        F.sum(F.col("k") - 1).alias("group_peers"), F.max("users").alias("largest_pool"), F.sum(F.col("users") - 1).alias("peers"),
    )


def behaviour(calls: DataFrame, subjects: DataFrame, by: str) -> DataFrame:
    """Calls of each province: callers, records, weight, means per caller and per calendar day, nights, active days, different targets."""
    joined = calls.join(subjects.select(F.col("id").alias("src"), by), "src")
    day = F.to_date("ts")
    days = F.date_diff(F.max(day), F.min(day)) + 1
    callers, records, night = F.count_distinct("src"), F.count("*"), F.count_if(is_night(F.col("ts")))
    r = lambda c, n: F.round(c, 4).alias(n)
    return joined.groupBy(by).agg(
        callers.alias("callers"), records.alias("records"), F.sum("duration").alias("weight"), F.count_distinct("dst").alias("targets"), night.alias("night_calls"), r(night / records, "night_ratio"),
        r(records / callers, "records_per_caller"), r(F.avg("duration"), "mean_duration"), F.count_distinct(day).alias("active_days"), days.alias("calendar_days"), r(records / days, "records_per_day"), r(records / days / callers, "records_per_day_and_caller"),
    )


def device_summary(scores: DataFrame, used: DataFrame, by: str) -> DataFrame:
    """Devices of each province: all, those with at least 2, 5 and 10 users, those used in other provinces too, and the mean share of risky users."""
    rows = used.select(by, "device").distinct().join(scores.select("device", "users", "provinces", "risk_ratio"), "device")
    return rows.groupBy(by).agg(F.count("*").alias("devices"), *(F.count_if(F.col("users") >= n).alias(f"at_least_{n}") for n in (2, 5, 10)), F.count_if(F.col("provinces") > 1).alias("across"), F.round(F.avg("risk_ratio"), 6).alias("mean_risk_ratio"))


def structure(feats: DataFrame, column: str, limits: list[float]) -> DataFrame:
    """Mean, median, upper tenth of a measure, and the share of rows at or over each limit: one row."""
    middle, tenth = ranks.quantiles(feats, column, [0.5, 0.9])
    return feats.agg(F.round(F.avg(column), 6).alias("mean"), *(F.round(F.avg((F.col(column) >= x).cast("double")), 6).alias(f"over_{i}") for i, x in enumerate(limits))).select("*", F.lit(middle).cast("double").alias("median"), F.lit(tenth).cast("double").alias("p90"))


def id_formats(df: DataFrame, column: str) -> DataFrame:
    """How long ids are: rows and share of each length, of these how many are hex."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.length(F.col(column).cast("string")).alias("length")).agg(F.count("*").alias("n"), F.count_if(F.col(column).cast("string").rlike("^[0-9a-fA-F]+$")).alias("hex"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.crossJoin(F.broadcast(total)).select("length", "n", "hex", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def quality_checks(df: DataFrame, key: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """A row per column: the share of nulls, and pass, warn or fail by its limits; and whether the key repeats."""
    known = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(f"k_{c}") for c in limits))
    repeats = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
    share = {c: F.round(1 - F.coalesce(F.try_divide(F.col(f"k_{c}"), F.col("rows")), F.lit(0.0)), 6) for c in limits}
    rows = [F.struct(F.lit(c).alias("check"), share[c].alias("value"), F.when(share[c] > fail, "fail").when(share[c] > warn, "warn").otherwise("pass").alias("status")) for c, (warn, fail) in limits.items()]
    rows.append(F.struct(F.lit(f"{key} repeats").alias("check"), F.col("repeats").cast("double").alias("value"), F.when(F.col("repeats") > 0, "fail").otherwise("pass").alias("status")))
    return known.crossJoin(F.broadcast(repeats)).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ranked_within(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def first_known(df: DataFrame, key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Of each key and column the first value, in order, that isn't null."""
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return df.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns))


def united_text(df: DataFrame, key: str, place: str, column: str) -> DataFrame:
    """A key's pieces of text in order, each different one (but for case and white space) once, empty lines between them."""
    normal = F.trim(F.lower(F.regexp_replace(column, "[ \\t\\n\\r]+", " ")))
    once = df.where(normal != "").groupBy(key, normal.alias("_n")).agg(F.min(F.struct(place, F.trim(column).alias("t"))).alias("f"))
    return once.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["t"]), "\n\n").alias("text"))


def aggregated(df: DataFrame, by: str, column: str) -> DataFrame:
    """Count, sum, mean, least and greatest of a column by another; the most frequent first."""
    made = (F.count("*").alias("n"), F.coalesce(F.round(F.sum(column), 4), F.lit(0.0)).alias("total"), F.round(F.avg(column), 4).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))
    return df.groupBy(by).agg(*made).orderBy(F.desc("n"), by)


def merged_sources(nodes: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys of both; the values of the first where it has them, else of the second."""
    other = derived.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return nodes.join(other, key, "full").select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns))


def all_of(items: DataFrame, owner: str, item: str, owners: list) -> DataFrame:
    """Items that each of the owners has."""
    return items.where(F.col(owner).isin(owners)).groupBy(item).agg(F.count_distinct(owner).alias("_n")).where(F.col("_n") == len(set(owners))).select(item)





"""What regions are used for, how places follow each other, and what stage a series is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of the functions' categories; the weights of (time ratio or None for the words) in each function's score.
WORDS = {
    "residential": ("residential", "apartment", "housing", "community", "neighborhood", "住宅", "小区"),
    "commercial": ("office", "company", "mall", "shop", "store", "bank", "market", "business", "building", "plaza", "商业", "写字楼"),
    "transit": ("station", "subway", "metro", "bus", "airport", "rail", "train", "transport", "地铁", "车站", "机场"),
    "leisure": ("cafe", "restaurant", "bar", "club", "park", "museum", "cinema", "entertainment", "hotel", "shopping", "餐厅", "公园", "酒店"),
}
SCORES = {
    "residential": {"night": 0.45, "weekend": 0.2, "words": 0.35},
    "commercial": {"workday": 0.45, "evening": 0.15, "words": 0.4},
    "transit": {"morning": 0.5, "evening": 0.5, "words": 0.5},
    "leisure": {"evening": 0.35, "night": 0.35, "weekend": 0.15, "words": 0.5},
}
#: Scores nearer to each other than this are mixed.
APART = 0.08
SEPARATORS = ("|", ";", ",", "/")


def categories(c: Column) -> Column:
    """The categories in a text: a JSON list, else parts at the first of SEPARATORS that is in it, else the text; trimmed, without empty ones. None for null."""
    text = F.btrim(F.coalesce(c, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    listed = text.startswith("[") & text.endswith("]") & parsed.isNotNull()
    parts = F.array(text)
    for s in reversed(SEPARATORS):
        parts = F.when(text.contains(s), F.split(text, "[" + s + "]")).otherwise(parts)
    return F.filter(F.transform(F.when(listed, parsed).otherwise(parts), lambda x: F.btrim(x)), lambda x: x != "")


def functions_of(records: DataFrame, region: str, user: str, ts: str, category: str) -> DataFrame:
    """A row for each region: activity, users, the share of its hours (6-10, 10-17, 17-22, else night, weekends), a score for each function, and the function: the best, or mixed.

    A function's words count by the share of the region's categories that have one of them in their name. A record without a time counts for no hour;
    a null region is left out."""
    hour, day = F.hour(ts), F.weekday(ts)
    within = {"morning": hour.between(6, 9), "workday": hour.between(10, 16), "evening": hour.between(17, 21), "night": (hour < 6) | (hour >= 22), "weekend": day >= 5}
    rows = records.where(F.col(region).isNotNull()).select(F.col(region).alias("region"), F.col(user).alias("user"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in within.items()), categories(F.col(category)).alias("c"))
    named = lambda words: F.size(F.filter("c", lambda x: F.lower(x).rlike("|".join(words))))
    has = {f: named(words) for f, words in WORDS.items()}
    sums = rows.groupBy("region").agg(
        F.count("*").alias("activity"), F.count_distinct("user").alias("users"), *(F.count_if(F.col(n)).alias(n) for n in within), F.sum(F.size("c")).alias("_c"), *(F.sum(h).alias(f"_{f}") for f, h in has.items())
    )
    ratios = sums.select("region", "activity", "users", *((F.col(n) / F.col("activity")).alias(n) for n in within), *(F.coalesce(F.try_divide(F.col(f"_{f}"), F.col("_c")), F.lit(0.0)).alias(f"_{f}") for f in WORDS))
    scores = {f: sum(w * F.col(f"_{f}" if p == "words" else p) for p, w in parts.items()) for f, parts in SCORES.items()}
    scored = ratios.withColumns({f: s for f, s in scores.items()})
    order = F.array_sort(F.array(*(F.struct((-F.col(f)).alias("n"), F.lit(i).alias("i"), F.lit(f).alias("f")) for i, f in enumerate(SCORES))))
    mixed = order[1]["n"] - order[0]["n"] < APART
    return scored.select("region", "activity", "users", *within, *SCORES, F.when(mixed, "mixed").otherwise(order[0]["f"]).alias("function"))


def pattern_support(visits: DataFrame, user: str, place: str, ts: str, order: str, longest: int, least: int) -> DataFrame:
    """(pattern, length, support): sequences of 1 to longest places, repeats in a row as one, and how many users have each, from least on.

    Users have their visits in order; a pattern is made from the next places of each visit, so no user's visits are held as a list. Null places are left out."""
    by = Window.partitionBy("u").orderBy("t", "o")
    rows = visits.where(F.col(place).isNotNull() & F.col(user).isNotNull()).select(F.col(user).alias("u"), F.col(place).cast("string").alias("p"), F.col(ts).alias("t"), F.col(order).alias("o"))
    kept = rows.withColumn("_before", F.lag("p").over(by)).where("_before IS NULL OR _before != p")
    ahead = kept.select("u", *(F.lead("p", i).over(by).alias(f"p{i}") for i in range(longest)))
    made = [F.when(F.col(f"p{n - 1}").isNotNull(), F.struct(F.concat_ws("->", *(f"p{i}" for i in range(n))).alias("pattern"), F.lit(n).alias("length"))) for n in range(1, longest + 1)]
    each = ahead.select("u", F.explode(F.array_compact(F.array(*made))).alias("m")).select("u", "m.*").distinct()
    return each.groupBy("pattern", "length").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def stage(recent: Column, baseline: Column, recent_night: Column, baseline_night: Column, anomaly_days: Column) -> Column:
    """What a subject's recent days are like, compared with those before: the change of records in percent, the change of the share of nights, and days out of line. Without records before there is no percentage."""
    percent = F.when(baseline != 0, 100.0 * (recent - baseline) / baseline)
    return (
        F.when((percent >= 50) & (anomaly_days >= 1), "spike_rising")
        .when((recent_night - baseline_night >= 0.15) & (recent >= baseline), "night_shift_rising")
        .when(percent <= -30, "cooling_down").when(anomaly_days >= 2, "volatile").otherwise("stable_or_mild")
    )


def out_of_line(n: Column, days: Column, total: Column, squares: Column) -> Column:
    """Whether a day's n lies more than one and a half population deviations above the mean, given the number of days, and the sums of n and of its square.

    In whole numbers, so that a day right at that bound is never beyond it: deviations as doubles depend on the order in which rows are added up."""
    wide = lambda c: c.cast("decimal(19,0)")
    off = wide(wide(n) * wide(days) - wide(total))
    return (off > 0) & (4 * (off * off) > 9 * (wide(days) * squares - wide(total) * wide(total)))


def fused_regions(evidence: DataFrame, region: str, visits: str, users: str, anomaly: str, change: str, category: str, source: str, k: int = 5) -> DataFrame:
    """Evidence of each region from several sources: sums of visits and users, rows, anomalies, the mean change, the k most frequent categories (the least of ties) and how many sources.

    Nulls count for nothing, a region without changes has none; a null or empty region is left out."""
    rows = evidence.where(F.col(region).isNotNull() & (F.col(region) != "")).select(
        F.col(region).alias("region"), F.col(visits).cast("double").alias("v"), F.col(users).cast("double").alias("u"), F.col(anomaly).alias("a"), F.col(change).cast("double").alias("c"), categories(F.col(category)).alias("k"), F.col(source).alias("s")
    )
    zero = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    sums = rows.groupBy("region").agg(zero("v").alias("visits"), zero("u").alias("users"), F.count("*").alias("n_evidence"), F.count_if(F.col("a")).alias("anomalies"), F.round(F.avg("c"), 2).alias("mean_change"), F.count_distinct("s").alias("n_sources"))
    named = category_counts(rows, "region", "k")
    order = Window.partitionBy("region").orderBy(F.desc("n"), "category")
    top = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]).alias("top_categories"))
    return sums.join(top, "region", "left").withColumn("top_categories", F.coalesce("top_categories", F.array().cast("array<string>")))


def category_counts(rows: DataFrame, region: str, parsed: str) -> DataFrame:
    """(region, category, n) of rows with their categories parsed into an array."""
    return rows.select(F.col(region).alias("region"), F.explode(parsed).alias("category")).groupBy("region", "category").agg(F.count("*").alias("n"))


#: What a section's trend says, and what the state of the whole says if the sections are at odds.
WORSE, BETTER = "加重", "缓解"
STATES = {1: ("steady_free", "low"), 2: ("steady_slow", "medium"), 3: ("steady_jam", "medium"), 4: ("steady_jam", "medium")}


def congestion_trend(sections: DataFrame, key: str, trend: str, status: DataFrame) -> DataFrame:
    """(key, votes, sections, trend, confidence) of each key of status (key, status): sections that get worse less those that get better, and, where these are as many, what the state of the whole says.

    A state of 2, 3 or 4 without any section has low confidence; an unknown one leaves the trend unknown."""
    votes = sections.groupBy(key).agg(F.sum(F.when(F.col(trend) == WORSE, 1).when(F.col(trend) == BETTER, -1).otherwise(0)).alias("votes"), F.count("*").alias("sections"))
    rows = status.select(key, "status").join(votes, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("votes", "sections")})
    named, sure = F.lit("unknown"), F.lit("low")
    for state, (name, confidence) in STATES.items():
        named = F.when(F.col("status") == state, name).otherwise(named)
        sure = F.when((F.col("status") == state) & (F.col("sections") > 0), confidence).otherwise(sure)
    moved = F.col("votes") != 0
    return rows.select(key, "votes", "sections", F.when(F.col("votes") > 0, "worse").when(F.col("votes") < 0, "better").otherwise(named).alias("trend"), F.when(moved, "medium").otherwise(sure).alias("confidence"))


def related_branches(items: DataFrame, key: str, path: str, name: str, asked, level: int = 3) -> DataFrame:
    """(key, name, place) of the items on the same branch as the one asked about (a key): those with the same first levels of path (array), itself too, in order of name. An unknown key has no rows."""
    branch = F.array_join(F.slice(path, 1, level), "\x1f")
    own = items.where(F.col(key) == asked).select(branch.alias("_branch")).distinct()
    rows = items.withColumn("_branch", branch).join(F.broadcast(own), "_branch", "left_semi")  # a row, unless the key repeats
    return rows.select(key, name, F.row_number().over(Window.partitionBy("_branch").orderBy(name, key)).alias("place"))

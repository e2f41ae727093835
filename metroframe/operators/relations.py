"""Relations between subjects: contact pairs, shared partners, hops, per-subject measures, risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import ranks


def contact_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Undirected pairs without loops, with their number of contacts."""
    return edges.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.count("*").alias("contacts"))


#: Members of one partner that meet others in one task.
BLOCK = 2048


def met(left: DataFrame, right: DataFrame, item: str) -> DataFrame:
    """left and right joined on item, which both have beside columns of their own.

    A popular item's rows are dealt into blocks of about BLOCK on either side, and each pair of blocks is a key of its own, so its pairs are made in
    many tasks. Every pair is made: a of the left and b of the right make a * b."""
    size = lambda df, name: df.groupBy(item).agg(F.ceil(F.count("*") / BLOCK).alias(name)).where(F.col(name) > 1)
    popular = size(left, "_left").join(size(right, "_right"), item, "full")
    dealt = lambda df: df.join(popular, item, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_left", "_right")})
    own = lambda df, n: F.pmod(F.xxhash64(*(c for c in df.columns if c != item)), n)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = dealt(left).select(*left.columns, own(left, F.col("_left")).alias("_i"), all_of("_right").alias("_j"))
    two = dealt(right).select(*right.columns, all_of("_left").alias("_i"), own(right, F.col("_right")).alias("_j"))
    return one.join(two, [item, "_i", "_j"]).drop("_i", "_j")


def shared_partners(edges: DataFrame, member: str, partner: str, least: int) -> DataFrame:
    """Pairs of members with at least so many partners in common. Edges are made distinct before they meet.

    Every pair that the question asks for is made, k * (k - 1) / 2 of them for a partner of k members, in blocks; they are added up before they are dealt by pair."""
    one = edges.where(F.col(partner).isNotNull() & F.col(member).isNotNull()).select(F.col(partner).alias("p"), F.col(member).alias("a")).distinct()
    pairs = met(one, one.withColumnRenamed("a", "b"), "p").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def hops(edges: DataFrame, src: str, dst: str, seeds: DataFrame, depth: int) -> DataFrame:
    """Nodes within depth steps of the seeds (column node), with the least number of steps."""
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    border = reached
    for hop in range(1, depth + 1):
        new = border.join(steps, "node").select(F.col("next").alias("node")).distinct().join(reached, "node", "left_anti")
        border = cut(edges.sparkSession, new.withColumn("hop", F.lit(hop)))  # written, so that no later step makes it again
        reached = reached.unionByName(border)
    return reached


def subject_metrics(events: DataFrame, user: str, category: str, ts: str, value: str) -> DataFrame:
    """Events, distinct categories, the share between 22 and 6 o'clock, the mean value and the share of active days of each user."""
    hour, day = F.hour(ts), F.to_date(ts)
    span = F.date_diff(F.max(day), F.min(day)) + 1
    return events.groupBy(user).agg(
        F.count("*").alias("n_events"),
        F.count_distinct(category).alias("n_categories"),
        F.round(F.avg(((hour >= 22) | (hour <= 6)).cast("double")), 6).alias("night_ratio"),
        F.round(F.avg(value), 4).alias("mean_value"),
        F.round(F.count_distinct(day) / span, 6).alias("active_ratio"),
    )


def screening_score(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Metrics with the weighted sum of their percent ranks, ties at their mean rank. Ranks come from counts of each different value, not of rows."""
    ranked = ranks.percent_ranks(metrics, {c: f"_rank_{c}" for c in weights})
    score = sum((w * F.col(f"_rank_{c}") for c, w in weights.items()), F.lit(0.0))
    return ranked.withColumn("screening_score", F.round(score, 4)).select(*metrics.columns, "screening_score")

"""Risk of subjects that call others and use devices: features, weighted scores, evidence, groups and their relations.

Calls are rows (src, dst, device, ts, duration), subjects (id, province, label, sub_label). A device that very many use is counted, its
pairs are made only within the group that is asked about, whose members are a table of any size, and in blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_night
from . import ranks
from .relations import met

# Weights of the components by mode and view, in the order of COMPONENTS.
COMPONENTS = ("label_risk", "call_records", "counterparties", "devices", "shared_devices", "shared_peers")
WEIGHTS = {
    ("mixed", "overall"): (0.20, 0.22, 0.22, 0.08, 0.15, 0.13),
    ("call_only", "overall"): (0.25, 0.38, 0.32, 0.03, 0.01, 0.01),
    ("device_only", "overall"): (0.25, 0.00, 0.00, 0.10, 0.35, 0.30),
    ("mixed", "unlabeled_only"): (0.00, 0.20, 0.20, 0.10, 0.25, 0.25),
    ("call_only", "unlabeled_only"): (0.00, 0.45, 0.45, 0.05, 0.03, 0.02),
    ("device_only", "unlabeled_only"): (0.00, 0.02, 0.03, 0.12, 0.43, 0.40),
    ("mixed", "device_priority"): (0.10, 0.05, 0.05, 0.15, 0.35, 0.30),
    ("call_only", "device_priority"): (0.10, 0.45, 0.35, 0.05, 0.03, 0.02),
    ("device_only", "device_priority"): (0.10, 0.00, 0.00, 0.15, 0.40, 0.35),
}
#: Users of a device that is a pool.
POOL = 3
LEVELS = ((75, "very_high"), (55, "high"), (35, "medium"))
BUCKETS = ((0.95, "top_5_percent"), (0.90, "top_10_percent"), (0.75, "top_25_percent"), (0.50, "middle_upper"))


def step(value: Column, steps, rest: str) -> Column:
    """The name of the first step that the value reaches; steps fall."""
    return reduce(lambda found, s: F.when(value >= s[0], s[1]).otherwise(found), reversed(steps), F.lit(rest))


def is_risk(label: Column, sub_label: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(label == 1, F.lit(False)) | F.coalesce(F.lower(sub_label).isin(*names), F.lit(False))


def device_edges(calls: DataFrame) -> DataFrame:
    """Each subject's different devices, with the number of subjects that use each."""
    one = calls.select("src", "device").where("device is not null").distinct()
    return one.join(one.groupBy("device").agg(F.count("*").alias("users")), "device")


def features(calls: DataFrame, subjects: DataFrame) -> DataFrame:
    """Of every subject, also one without calls: records, different counterparts, nights, mean duration, devices, those shared, peers on them, pools (devices of at least POOL users), and the device with most users (the least of ties)."""
    own = calls.groupBy("src").agg(
        F.count("*").alias("call_records"), F.count_distinct("dst").alias("counterparties"), F.count_if(is_night(F.col("ts"))).alias("night_calls"), F.round(F.avg("duration"), 4).alias("mean_duration")
    )
    used = device_edges(calls).groupBy("src").agg(
        F.count("*").alias("devices"), F.count_if(F.col("users") > 1).alias("shared_devices"), F.sum(F.col("users") - 1).alias("shared_peers"), F.count_if(F.col("users") >= POOL).alias("pools"),
        F.min(F.struct((-F.col("users")).alias("n"), "device")).alias("b"),
    )
    used = used.select("src", "devices", "shared_devices", "shared_peers", "pools", F.col("b.device").alias("strongest_device"), (-F.col("b.n") - 1).alias("strongest_peers"))
    known = subjects.join(own, F.col("id") == own["src"], "left").drop("src").join(used, F.col("id") == used["src"], "left").drop("src")
    counts = ("call_records", "counterparties", "night_calls", "devices", "shared_devices", "shared_peers", "pools", "strongest_peers")
    known = known.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return known.withColumn("night_ratio", F.round(F.coalesce(F.try_divide(F.col("night_calls"), F.col("call_records")), F.lit(0.0)), 6))


def with_ranks(feats: DataFrame) -> DataFrame:
    """Features with the percent rank of each measure over all subjects, before any of them is left out."""
    return ranks.percent_ranks(feats, {c: f"{c}_rank" for c in COMPONENTS[1:]})


def weighted(ranked: DataFrame, risk: Column, *asked: tuple[str, str]) -> DataFrame:
    """Each subject once for each (mode, view) asked that it belongs to, with risk_score, 100 times the weighted sum of ranks and label, and driver: what the greatest component is about.

    Views leave out labelled subjects, or those without shared devices. All modes and views come from the same rows, which meet nothing."""
    numbers = lambda w: F.array(*(F.lit(float(x)) for x in w))
    made = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(v).alias("view"), numbers(WEIGHTS[m, v]).alias("w")) for m, v in asked))
    in_view = lambda x: F.when(x["view"] == "unlabeled_only", ~risk).when(x["view"] == "device_priority", (F.col("shared_devices") > 0) | (F.col("shared_peers") > 0)).otherwise(True)
    one = ranked.select("*", F.explode(F.filter(made, in_view)).alias("_asked"))
    values = [risk.cast("double"), *(F.col(f"{c}_rank") for c in COMPONENTS[1:])]
    weights = [F.col("_asked.w")[i] for i in range(len(values))]
    parts = [F.round(100.0 * w * v, 6) for w, v in zip(weights, values)]
    order = F.sort_array(F.array(*(F.struct(p.alias("v"), F.lit(-i).alias("o")) for i, p in enumerate(parts))), asc=False)
    scored = one.withColumns({"_order": order, "mode": F.col("_asked.mode"), "view": F.col("_asked.view"), "risk_score": F.round(sum(100.0 * w * v for w, v in zip(weights, values)), 6)})
    top, second = -F.col("_order")[0]["o"], -F.col("_order")[1]["o"]
    driver = (
        F.when(F.col("_order")[0]["v"] <= 0, "weak")
        .when((top == 0) & (second >= 3), "label_and_devices").when((top == 0) & (second >= 1), "label_and_calls").when(top == 0, "label")
        .when(top >= 3, "devices").when(top == 2, "contacts").otherwise("calls")
    )
    return scored.withColumn("driver", driver).drop("_asked", "_order")


def top_of_view(scored: DataFrame, view: str, k: int) -> DataFrame:
    """The first k of a view by its own order, with the level of the score and the bucket of its rank in the view."""
    keys = ["shared_peers", "shared_devices", "devices"] if view == "device_priority" else ["counterparties", "call_records", "shared_peers"]
    ranked = ranks.percent_ranks(scored, {"risk_score": "percentile"})
    named = ranked.withColumns({"level": step(F.col("risk_score"), LEVELS, "attention"), "bucket": step(F.round("percentile", 6), BUCKETS, "long_tail")})
    return named.orderBy(F.desc("risk_score"), *(F.desc(c) for c in keys), "id").limit(k)


def screening(matched: DataFrame, boosters: dict[str, float]) -> DataFrame:
    """screening_score: 10 for each condition met, weighted percent ranks over the rows given (those that were screened), 2 for a risk. A booster without any value over 0 is left out."""
    tops = matched.agg(*(F.max(c).alias(c) for c in boosters)).first()
    used = {c: w for c, w in boosters.items() if (tops[c] or 0) > 0}
    ranked = ranks.percent_ranks(matched, {c: f"_rank_{c}" for c in used})
    score = 10.0 * F.col("hits") + sum((w * F.col(f"_rank_{c}") for c, w in used.items()), F.lit(0.0)) + 2.0 * F.col("risk_flag").cast("int")
    return ranked.withColumn("screening_score", F.round(score, 4)).drop(*(f"_rank_{c}" for c in used))


def overlap_peers(calls: DataFrame, members: DataFrame) -> DataFrame:
    """For each member (id) and every other subject: counterparts in common. Only the members' counterparts are joined."""
    one = calls.select("src", "dst").distinct()
    own = one.join(members.select(F.col("id").alias("src")), "src", "left_semi").withColumnRenamed("src", "id")
    return met(own, one.withColumnRenamed("src", "peer"), "dst").where("id != peer").groupBy("id", "peer").agg(F.count("*").alias("common"))


def shared_peers(calls: DataFrame, members: DataFrame) -> DataFrame:
    """For each member and every other subject: devices in common."""
    one = calls.select("src", "device").distinct()
    own = one.join(members.select(F.col("id").alias("src")), "src", "left_semi").withColumnRenamed("src", "id")
    return met(own, one.withColumnRenamed("src", "peer"), "device").where("id != peer").groupBy("id", "peer").agg(F.count("*").alias("devices_shared"))


def evidence(feats: DataFrame, common: Column, volume: Column, risk: Column, trusted: Column) -> DataFrame:
    """score from 0 to 100 of label, breadth, volume, devices, overlap and nights, each up to its own limit."""
    parts = {
        "label_score": F.when(risk, 28.0).when(trusted, -10.0).otherwise(0.0),
        "breadth_score": F.least(F.lit(20.0), F.log1p("counterparties") * 3.2),
        "volume_score": F.least(F.lit(15.0), F.log1p(F.greatest(volume, F.col("call_records"))) * 1.6),
        "device_score": F.least(F.lit(20.0), F.col("shared_devices") * 2.5 + F.log1p("shared_peers") * 2.2),
        "overlap_score": F.least(F.lit(12.0), F.log1p(common) * 4.0),
        "night_score": F.when(F.col("call_records") > 0, F.least(F.lit(10.0), F.greatest(F.lit(0.0), (F.col("night_ratio") - 0.15) * 20))).otherwise(0.0),
    }
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum(parts.values())))
    return feats.select("id", *(F.round(p, 2).alias(n) for n, p in parts.items()), F.round(total, 2).alias("score"))


def _pairs(edges: DataFrame, members: DataFrame, item: str) -> DataFrame:
    """Pairs of members (a < b) that have an item in common, with the item."""
    one = edges.select(F.col("src").alias("a"), item).distinct().join(members.select(F.col("id").alias("a")), "a", "left_semi")
    return met(one, one.withColumnRenamed("a", "b"), item).where("a < b")


def device_pairs(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of members with devices in common: how many, the most users one of them has, and which."""
    users = device_edges(calls).select("device", "users").distinct()
    return _pairs(calls, members, "device").join(users, "device").groupBy("a", "b").agg(F.count("*").alias("shared_devices"), F.max("users").alias("largest_pool"), F.array_join(F.array_sort(F.collect_set("device")), ", ").alias("devices"))


def direct_pairs(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of members that called each other: records, and in how many directions."""
    ids = members.select("id")
    both = calls.select("src", "dst").where("src != dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("internal_calls"), F.count_distinct("src").alias("directions"))


def counterpart_pairs(calls: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Pairs of members with at least max(2, least) counterparts in common: how many, and the calls of both to them."""
    weights = calls.groupBy("src", "dst").agg(F.count("*").alias("n")).join(members.select(F.col("id").alias("src")), "src", "left_semi")
    one, two = weights.select(F.col("src").alias("a"), "dst", F.col("n").alias("n1")), weights.select(F.col("src").alias("b"), "dst", F.col("n").alias("n2"))
    pairs = met(one, two, "dst").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common_counterparts"), F.sum(F.col("n1") + F.col("n2")).alias("common_calls"))
    return pairs.where(F.col("common_counterparts") >= max(2, least))


def relation_matrix(calls: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """All evidence on each pair of members side by side, 0 where there is none; relation_score: 8 a device, 2 a call, 3 a counterpart."""
    kinds = (device_pairs(calls, members), direct_pairs(calls, members), counterpart_pairs(calls, members, least))
    out = reduce(lambda x, y: x.join(y, ["a", "b"], "full"), kinds)
    counts = ("shared_devices", "largest_pool", "internal_calls", "directions", "common_counterparts", "common_calls")
    out = out.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "devices": F.coalesce("devices", F.lit(""))})
    names = {"shared_device": "shared_devices", "internal_call": "internal_calls", "common_counterparty": "common_counterparts"}
    types = F.concat_ws(", ", *(F.when(F.col(c) > 0, n) for n, c in names.items()))
    score = 8 * F.col("shared_devices") + 2 * F.col("internal_calls") + 3 * F.col("common_counterparts")
    return out.withColumns({"relation_types": F.when(types == "", "weak_or_none").otherwise(types), "relation_score": score})


def gang_pairs(calls: DataFrame, members: DataFrame, feats: DataFrame, least_score: float, least_common: int, least_overlap: float) -> DataFrame:
    """Pairs whose relation_score (8 a device, 3 a counterpart, 4 a call, 100 times the share of counterparts) is high enough and which have a device, a call, enough counterparts or enough overlap."""
    cp = _pairs(calls, members, "dst").groupBy("a", "b").agg(F.count("*").alias("common_counterparts"))
    merged = cp.join(direct_pairs(calls, members).drop("directions"), ["a", "b"], "full").join(device_pairs(calls, members).select("a", "b", "shared_devices"), ["a", "b"], "full")
    merged = merged.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("common_counterparts", "internal_calls", "shared_devices")})
    sizes = feats.select("id", "counterparties")
    merged = merged.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    overlap = F.col("common_counterparts") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("common_counterparts"), F.lit(1))
    merged = merged.withColumn("overlap", overlap)
    score = F.col("shared_devices") * 8 + F.col("common_counterparts") * 3 + F.col("internal_calls") * 4 + F.col("overlap") * 100
    kept = (score >= least_score) & ((F.col("shared_devices") >= 1) | (F.col("common_counterparts") >= least_common) | (F.col("overlap") >= least_overlap) | (F.col("internal_calls") > 0))
    return merged.where(kept).select("a", "b", "shared_devices", "common_counterparts", "internal_calls", F.round("overlap", 4).alias("overlap"), F.round(score, 2).alias("relation_score"))


def member_signals(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """signal_score of members: their pairs' scores, shared devices, counterparts, calls and nights."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "relation_score").groupBy("id").agg(F.round(F.sum("relation_score"), 2).alias("weighted_degree"))
    score = F.col("weighted_degree") * 0.45 + F.col("shared_devices") * 8 + F.col("counterparties") * 0.08 + F.col("call_records") * 0.03 + F.col("night_ratio") * 20
    return ends.join(feats, "id").select("id", "weighted_degree", F.round(score, 2).alias("signal_score"))


def core_scores(feats: DataFrame, internal: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Flags of a group's members against the upper quartile of the group (at least the floors), and group_core_score."""
    found = ranks.quantile_table(feats, list(floors), [[0.75]] * len(floors))
    limits = {c: max(f, q[0] or 0.0) for (c, f), q in zip(floors.items(), found)}
    flags = {
        "flag_calls": F.col("call_records") >= limits["call_records"],
        "flag_contacts": F.col("counterparties") >= limits["counterparties"],
        "flag_devices": (F.col("shared_devices") >= 1) | (F.col("shared_peers") >= limits["shared_peers"]),
        "flag_nights": (F.col("night_calls") >= 3) & (F.col("night_ratio") >= 0.3),
    }
    signals = sum(f.cast("int") for f in flags.values())
    joined = feats.join(internal, "id", "left").withColumn("internal_neighbours", F.coalesce("internal_neighbours", F.lit(0)))
    score = (
        signals * 20 + F.least(F.col("shared_peers"), F.lit(200)) * 0.4 + F.least(F.col("call_records"), F.lit(500)) * 0.03 + F.least(F.col("counterparties"), F.lit(500)) * 0.05
        + F.least(F.col("pools"), F.lit(20)) * 3 + F.least(F.col("internal_neighbours"), F.lit(20)) * 2 + F.coalesce((F.col("label") == 1).cast("int"), F.lit(0)) * 8
    )
    return joined.select("id", *(f.alias(n) for n, f in flags.items()), signals.alias("signal_count"), "internal_neighbours", F.round(score, 4).alias("group_core_score"))


def device_scores(calls: DataFrame, subjects: DataFrame, risk: Column) -> DataFrame:
    """Of each device: users, risky ones, provinces, labels, the score, and what kind of pool it is."""
    users = calls.select(F.col("src").alias("id"), "device").distinct().join(subjects.withColumn("_risk", risk), "id")
    stats = users.groupBy("device").agg(F.count("*").alias("users"), F.count_if("_risk").alias("risky"), F.count_distinct("province").alias("provinces"), F.count_distinct("sub_label").alias("labels"))
    stats = stats.withColumn("risk_ratio", F.round(F.col("risky") / F.col("users"), 6))
    score = F.log1p("users") * 5 + F.col("risky") * 3 + F.col("risk_ratio") * 8 + F.when(F.col("provinces") > 1, 2.0).otherwise(0.0) + F.when(F.col("labels") > 1, 1.5).otherwise(0.0)
    kind = F.when((F.col("users") >= 10) & (F.col("risk_ratio") >= 0.8), "high_risk_device_pool").when((F.col("users") >= 5) & (F.col("provinces") > 1), "cross_region_device_pool")
    return stats.withColumns({"score": F.round(score, 6), "focus": kind.when(F.col("users") >= 5, "shared_device_pool").otherwise("normal_or_weak_signal")})


def related_subjects(peers: DataFrame, feats: DataFrame, risk: Column) -> DataFrame:
    """Peers on shared devices, scored: 10 for a risk, 6 a shared device, 3 times the log of their devices."""
    joined = peers.join(feats.withColumn("_risk", risk).select(F.col("id").alias("peer"), "devices", "_risk"), "peer")
    score = F.when(F.col("_risk"), 10.0).otherwise(0.0) + F.col("devices_shared") * 6.0 + F.log1p("devices") * 3.0
    return joined.select("id", "peer", "devices_shared", F.round(score, 6).alias("score"))


def pair_strength(devices: Column, common: Column, jaccard: Column) -> Column:
    return F.when((devices >= 1) | (common >= 5), "strong").when((common >= 3) | (jaccard >= 0.1), "medium").when(common >= 1, "weak").otherwise("none")


def common_item_scores(calls: DataFrame, one, two) -> tuple[DataFrame, DataFrame]:
    """Counterparts and devices that two subjects have in common, scored by how often and how widely they are used."""
    edges = calls.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.*")
    shared = calls.where(F.col("src").isin(one, two)).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("k")).where("k = 2").select("node")
    counterparts = edges.join(shared, "node", "left_semi").groupBy("node").agg(F.count("*").alias("calls"), F.count_distinct("other").alias("degree"))
    counterparts = counterparts.withColumn("score", F.round(F.log1p("calls") + F.log1p("degree"), 6))
    used = calls.select("src", "device").distinct()
    held = used.where(F.col("src").isin(one, two)).groupBy("device").agg(F.count("*").alias("k")).where("k = 2").select("device")
    devices = used.join(held, "device", "left_semi").groupBy("device").agg(F.count("*").alias("users")).withColumn("score", F.round(F.log1p("users") * 5, 6))
    return counterparts, devices


# Members that share a device or a counterpart from which it shapes a cluster, the mean score of its pairs that is dense, and the names of shapes.
SHAPING, DENSE = 3, 15.0
SHAPES = ("shared_devices_and_counterparts", "shared_devices", "common_counterparts", "weakly_coupled", "loose_candidates")


def cluster_shapes(calls: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """What holds each cluster (node, cluster) together: the most members on one device and with one counterpart, the mean score of its pairs (a, b, relation_score), and the shape that follows."""
    of = clusters.select(F.col("node").alias("src"), "cluster")
    inside = calls.join(of, "src")

    def most(item: str, name: str) -> DataFrame:
        each = inside.where(F.col(item).isNotNull()).select("cluster", item, "src").distinct().groupBy("cluster", item).agg(F.count("*").alias("n"))
        return each.groupBy("cluster").agg(F.max("n").alias(name))

    scores = pairs.join(clusters.select(F.col("node").alias("a"), "cluster"), "a").groupBy("cluster").agg(F.avg("relation_score").alias("mean_score"))
    rows = clusters.groupBy("cluster").agg(F.count("*").alias("size")).join(most("device", "on_device"), "cluster", "left").join(most("dst", "with_counterpart"), "cluster", "left").join(scores, "cluster", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("on_device", "with_counterpart", "mean_score")})
    device, counterpart, dense = F.col("on_device") >= SHAPING, F.col("with_counterpart") >= SHAPING, F.col("mean_score") >= DENSE
    shape = F.when(device & counterpart, SHAPES[0]).when(device, SHAPES[1]).when(counterpart, SHAPES[2]).when(dense, SHAPES[3]).otherwise(SHAPES[4])
    return rows.select("cluster", "size", "on_device", "with_counterpart", F.round("mean_score", 4).alias("mean_score"), shape.alias("shape"))


def group_signals(calls: DataFrame, own: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subjects with the call_records, night_ratio and whether shared_devices is above 0 that features has, from all calls and their own; devices are told by the first and last subject on each."""
    counts = own.groupBy("src").agg(F.count("*").alias("call_records"), F.count_if(is_night(F.col("ts"))).alias("_nights"))
    shared = calls.where("device is not null").groupBy("device").agg(F.min("src").alias("_a"), F.max("src").alias("_b")).where("_a != _b").select("device")
    holders = own.select("src", "device").join(shared, "device", "left_semi").select("src").distinct().withColumn("sharing", F.lit(True))
    known = subjects.join(counts, F.col("id") == counts["src"], "left").drop("src").join(holders, F.col("id") == holders["src"], "left").drop("src")
    known = known.withColumns({"call_records": F.coalesce("call_records", F.lit(0)), "sharing": F.coalesce("sharing", F.lit(False))})
    return known.withColumn("night_ratio", F.round(F.coalesce(F.try_divide(F.col("_nights"), F.col("call_records")), F.lit(0.0)), 6)).drop("_nights")


def group_assessment(own: DataFrame, feats: DataFrame, pairs: DataFrame, components: DataFrame, patterns: list[str]) -> DataFrame:
    """One row about a group: members, density of calls within it, its parts of two or more (of components, node and component), how complete the evidence is, and how sure one may be.

    own: the calls that members made. feats: the members' features with a flag for each of patterns, which is one of the group's if at least half of the members have it. pairs: one row with how many pairs of members there are (pairs), that call each other
    (calling_pairs) and that share a device (device_pairs). Confidence adds a fifth for each pattern, for pairs with devices over members (up to one), for counterparts that two members or more have (up to five), for the evidence, and for parts. An empty group has 0 in all."""
    n = F.col("members")
    flags = feats.agg(F.count("*").alias("members"), *(F.count_if(p).alias(f"_{p}") for p in patterns), F.count_if(F.col("province").isNotNull() | F.col("sub_label").isNotNull()).alias("_profiles"))
    parts = components.groupBy("component").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") >= 2).alias("parts"), F.coalesce(F.max("k"), F.lit(0)).alias("largest_part"))
    timed = own.agg(F.count("ts").alias("_timed"), F.count("device").alias("_devices"))
    shared = own.groupBy("dst").agg(F.min("src").alias("a"), F.max("src").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("shared_counterparts"))
    row = flags.crossJoin(pairs).crossJoin(parts).crossJoin(timed).crossJoin(shared)  # one row each
    major = sum((F.when(n > 0, 2 * F.col(f"_{p}") >= n).otherwise(False).cast("int") for p in patterns), F.lit(0))
    known = [F.col("_profiles") > 0, F.col("_timed") > 0, F.col("_devices") > 0, F.col("pairs") > 0, F.col("shared_counterparts") > 0, F.col("parts") > 0]
    evidence = F.round(sum(k.cast("int") for k in known) / 6.0, 3)
    within = lambda x: F.least(F.lit(1.0), x)
    sure = within(0.2 * major + 0.2 * within(F.col("device_pairs") / F.greatest(n, F.lit(1))) + 0.2 * within(F.col("shared_counterparts") / 5.0) + 0.2 * evidence + 0.2 * (F.col("parts") > 0).cast("int"))
    density = F.coalesce(F.try_divide(F.col("calling_pairs"), n * (n - 1) / 2), F.lit(0.0))
    return row.select("members", "pairs", "calling_pairs", "device_pairs", "parts", "largest_part", "shared_counterparts", F.round(density, 6).alias("call_density"), major.alias("patterns"), evidence.alias("completeness"), F.round(sure, 3).alias("confidence"))

"""The circle around one subject: who is in it by calls or devices, and who of it comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

MODES = ("mixed", "call_only", "device_only")


def circle(calls: DataFrame, devices: DataFrame, centre, hops: int, mode: str = "mixed") -> DataFrame:
    """(node, hop) of calls (src, dst), either way, and devices (member, device): the nodes that a mode's relations reach from the centre, itself with 0. Devices are stepped through, their pairs are never made."""
    if mode not in MODES:
        raise ValueError(f"a mode is one of {MODES}")
    spark = calls.sparkSession
    pairs = calls.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    both = pairs.union(pairs.select("dst", "src")).toDF("node", "next").distinct()
    used = devices.where("member IS NOT NULL AND device IS NOT NULL").select("member", "device").distinct()
    reached = border = spark.createDataFrame([(centre, 0)], "node long, hop int")
    for hop in range(1, hops + 1):
        steps = []
        if mode != "device_only":
            steps.append(border.join(both, "node").select(F.col("next").alias("node")))
        if mode != "call_only":
            held = border.join(used, F.col("node") == F.col("member")).select("device").distinct()
            steps.append(used.join(held, "device", "left_semi").select(F.col("member").alias("node")))
        new = (steps[0] if len(steps) == 1 else steps[0].union(steps[1])).distinct().join(reached, "node", "left_anti")
        border = cut(spark, new.withColumn("hop", F.lit(hop)))
        if border.isEmpty():
            break
        reached = reached.unionByName(border)
    return reached


def priorities(calls: DataFrame, devices: DataFrame, nodes: DataFrame, centre, mode: str = "mixed") -> DataFrame:
    """priority_score of each of nodes (node) but the centre, with what it is made of.

    5 for a shared device, 4 for a call with the centre, 3 for both, 2.5 times the logs of the shared devices' other users, 1.8 times the log of
    calls with the centre, 1.2 times the log of links within nodes, 1.5 for two shared devices or more. Links are calls between nodes, and the
    other nodes on each device, counted from the device's members."""
    ids = cut(calls.sparkSession, nodes.select("node").distinct())
    used = devices.where("member IS NOT NULL AND device IS NOT NULL").select("member", "device").distinct()
    mine = used.where(F.col("member") == centre).select("device")
    shared = used.join(mine, "device", "left_semi")
    crowd = shared.groupBy("device").agg((F.count("*") - 1).alias("peers"))
    by_device = shared.join(crowd, "device").groupBy(F.col("member").alias("node")).agg(F.count("*").alias("shared_devices"), F.sum("peers").alias("shared_peers"), F.sum(F.log1p("peers")).alias("_strength"))
    other = F.when(F.col("src") == centre, F.col("dst")).when(F.col("dst") == centre, F.col("src"))
    by_call = calls.withColumn("node", other).where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("calls_with_centre"))
    inside = calls.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    call_degree = inside.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("call_degree"))
    on = used.join(ids.withColumnRenamed("node", "member"), "member", "left_semi")
    device_degree = on.join(on.groupBy("device").agg((F.count("*") - 1).alias("n")), "device").groupBy(F.col("member").alias("node")).agg(F.sum("n").alias("device_degree"))
    out = ids.where(F.col("node") != centre)
    counts = ["shared_devices", "shared_peers", "_strength", "calls_with_centre"]
    for part in (by_device, by_call, *([call_degree] if mode != "device_only" else []), *([device_degree] if mode != "call_only" else [])):
        out = out.join(part, "node", "left")
    for c in ("call_degree", "device_degree"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0).cast("long"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    device, call = F.col("shared_devices") > 0, F.col("calls_with_centre") > 0
    given = lambda flag, points: F.when(flag, points).otherwise(0.0)
    score = given(device, 5.0) + given(call, 4.0) + given(device & call, 3.0) + 2.5 * F.col("_strength") + 1.8 * F.log1p("calls_with_centre") + 1.2 * F.log1p(F.col("call_degree") + F.col("device_degree")) + given(F.col("shared_devices") >= 2, 1.5)
    return out.select("node", "shared_devices", "shared_peers", "calls_with_centre", "call_degree", "device_degree", F.round(score, 6).alias("priority_score"))

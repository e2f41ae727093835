"""Onboarding, circles, scenes and regions on small tables: nulls, ties, repeats, no rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from metroframe.operators import circles, onboarding, regional, scene_terms
from metroframe.plans import people


def test_values_and_ids(spark):
    values = [None, "", " nan ", "NULL", "NaT", "12.0", "12.50", "-3.0", " a b ", "ab" * 8, "AB" * 8, "g" * 16, "1e5.0", "0.0", "١.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", onboarding.clean_value(F.col("v")).alias("c"), onboarding.typed_id(F.col("v"), "phone", "s").alias("id"), onboarding.typed_id(F.col("v"), "phone", "s", 8, keep=False).alias("short")).orderBy("i").collect()
    cleaned = ["", "", "", "", "", "12", "12.50", "-3.0", "a b", "ab" * 8, "AB" * 8, "g" * 16, "1e5.0", "0", "١.0"]
    assert [r["c"] for r in rows] == cleaned
    hashed = lambda v, n: hashlib.sha512(f"phone|{v}|s".encode()).hexdigest()[:n] if v else None
    assert [r["id"] for r in rows] == [v.lower() if v in ("ab" * 8, "AB" * 8) else hashed(v, 24) for v in cleaned]
    assert [r["short"] for r in rows] == [hashed(v, 8) for v in cleaned]
    numbers = spark.createDataFrame([(1.0,), (2.5,), (None,)], "v double").select(onboarding.clean_value(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in numbers] == ["1", "2.5", ""]


def test_onboard(spark):
    rows = [("1.0", "2", "d1", "Fraud", None, "2024-01-02 03:04:05", "x"), ("1", "none", None, "0", "VIP", "soon", "7.5"), (None, "2", "d1", "1", None, None, None), ("3", "1", "d1", "maybe", None, None, "1"), ("3", "1", "d1", "maybe", None, None, "1")]
    raw = spark.createDataFrame(rows, "p string, c string, d string, l string, s string, t string, secs string")
    roles = {"phone": "p", "counterparty": "c", "device": "d", "label": "l", "sub_label": "s", "time": "t", "duration": "secs"}
    made = onboarding.onboard(raw, roles, "set", "salt", "file")
    name = lambda v, kind="phone": hashlib.sha512(f"{kind}|{v}|salt".encode()).hexdigest()[:24]
    assert Counter((r["user_id"], r["label"], r["sub_label"], r["province"]) for r in made["users"].collect()) == Counter([(name(1), 1, "risk", "unknown"), (name(1), 0, "vip", "unknown"), (name(3), None, "unknown", "unknown"), (name(3), None, "unknown", "unknown")])
    assert Counter((r["src_user_id"], r["dst_counterparty_id"], r["event_hour"], r["duration"]) for r in made["calls"].collect()) == Counter([(name(1), name(2), 3, None)] + [(name(3), name(1), None, 1.0)] * 2)
    assert Counter((r["src_id"], r["dst_id"]) for r in made["devices"].collect()) == Counter([(name(1), name("d1", "device"))] + [(name(3), name("d1", "device"))] * 2)
    assert onboarding.onboard(raw, {}, "set", "salt", "file")["users"].collect() == []
    assert onboarding.quality(raw, roles).first().asDict() == {"rows": 5, "without_phone": 1, "without_counterpart": 1, "without_device": 1, "broken_times": 1, "repeated": 1}
    assert onboarding.quality(raw.limit(0), roles).first()["rows"] == 0


def test_linkability(spark):
    calls = lambda rows: spark.createDataFrame(rows, "src_user_id string, dst_counterparty_id string, imei string")
    level = lambda one, two: tuple(onboarding.linkability(calls(one), calls(two)).select("level", "score", "signals").first())
    one = [("aa", "bb", "i1"), ("aa", "cc", None)]
    assert level(one, [("dd", "bb", "i1")]) == (onboarding.MANY, 3, 2)
    assert level(one, [("bb", "zz", "i9"), ("bb", "yy", None)]) == (onboarding.ONE, 2, 1)
    assert level(one, [("dd", "ee", "i9")]) == (onboarding.UNKNOWN, 1, 0)
    assert level(one, [("dddd", "eeee", "i9")]) == (onboarding.APART, 0, 0)
    assert level(one, []) == (onboarding.UNKNOWN, 1, 0)


@pytest.mark.parametrize("mode", circles.MODES)
def test_circles(spark, mode):
    chance = random.Random(7)
    calls = [(chance.randrange(40), chance.randrange(40)) for _ in range(40)] + [(None, 1), (1, None), (0, 0), (0, 5), (5, 0)]
    devices = [(chance.randrange(40), chance.randrange(14)) for _ in range(30)] + [(None, 1), (1, None), (0, 3), (0, 3), (5, 3), (0, 4), (5, 4)]
    near, on, of = defaultdict(set), defaultdict(set), defaultdict(set)
    for a, b in calls:
        if None not in (a, b):
            near[a].add(b)
            near[b].add(a)
    for m, d in devices:
        if None not in (m, d):
            on[d].add(m)
            of[m].add(d)
    reached, border = {0: 0}, {0}
    for hop in (1, 2):
        new = set()
        for n in border:
            new |= near[n] if mode != "device_only" else set()
            new |= {m for d in of[n] for m in on[d]} if mode != "call_only" else set()
        border = new - reached.keys()
        reached |= dict.fromkeys(border, hop)
    c, d = spark.createDataFrame(calls, "src long, dst long"), spark.createDataFrame(devices, "member long, device long")
    found = circles.circle(c, d, 0, 2, mode)
    assert {r["node"]: r["hop"] for r in found.collect()} == reached
    scores = {r["node"]: r["priority_score"] for r in circles.priorities(c, d, found, 0, mode).collect()}
    assert set(scores) == set(reached) - {0}
    for n, got in scores.items():
        shared = of[n] & of[0]
        freq = sum({a, b} == {0, n} for a, b in calls)
        degree = (sum((a == n) + (b == n) for a, b in calls if a in reached and b in reached) if mode != "device_only" else 0) + (sum(len(on[x] & reached.keys()) - 1 for x in of[n]) if mode != "call_only" else 0)
        want = 5 * bool(shared) + 4 * bool(freq) + 3 * bool(shared and freq) + 2.5 * sum(math.log1p(len(on[x]) - 1) for x in shared) + 1.8 * math.log1p(freq) + 1.2 * math.log1p(degree) + 1.5 * (len(shared) >= 2)
        assert got == pytest.approx(want, abs=1e-6)


def test_scenes(spark):
    scenes = {"a": {"strong_keywords": ["Red Car"], "keywords": ["car"], "anti_keywords": ["boat"], "name": ["fast car, slow"]}, "b": {"description": ["boat trip"], "strong_anti_keywords": ["car"]}}
    terms = scene_terms.term_table(scenes)
    assert ("a", "car", 2.7, 0.0) in terms and ("a", "redcar", 4.5, 0.0) in terms and ("b", "car", 0.0, -6.0) in terms and ("a", "fast", 2.5, 0.0) in terms
    rows = spark.createDataFrame([(1, "A RED  car"), (2, "boat trip"), (3, None), (4, ""), (5, "car boat"), (1, "A RED  car"), (6, "boat " * 100_000)], "k int, text string")
    got = Counter((r["k"], r["scene"], r["points"], r["score"]) for r in scene_terms.scene_scores(rows, "k", "text", terms).collect())
    assert got == Counter([(1, "a", 7.2, 0.95)] * 2 + [(2, "b", 3.0, 0.75), (6, "b", 1.5, 0.6)])
    assert scene_terms.scene_scores(rows, "k", "text", []).collect() == []
    made = [(1, "x", 0.9, True, False, False), (1, "y", 0.95, False, False, False), (1, "z", 0.64, False, False, False), (1, "w", 0.1, False, False, True), (1, "v", 0.99, False, True, True), (2, "x", 0.5, False, False, False), (3, "y", 0.7, False, False, False), (3, "x", 0.7, False, False, False), (4, "x", 0.1, True, False, False)]
    found = scene_terms.resolved(spark.createDataFrame(made, "k int, skill string, score double, in_scene boolean, refused boolean, asked_for boolean"), "k").collect()
    assert {(r["k"], r["skill"], r["role"]) for r in found} == {(1, "x", "primary"), (1, "y", "supporting"), (1, "w", "supporting"), (3, "x", "primary"), (3, "y", "supporting"), (4, "x", "primary")}


def test_categories(spark):
    values = [None, "", " a ", '["x", " ", "y "]', "[broken", "a|b,c", "a;b", "a, b,", "a/b", "[1, 2]"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", regional.categories(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [[], [], ["a"], ["x", "y"], ["[broken"], ["a", "b,c"], ["a", "b"], ["a", "b"], ["a", "b"], ["1", "2"]]


def test_region_functions(spark):
    rows = [("r", "u1", "2024-01-06 23:00:00", "Hotel"), ("r", "u1", "2024-01-06 02:00:00", None), ("q", "u2", None, "Bank"), ("q", None, "2024-01-03 12:00:00", "office"), (None, "u", "2024-01-03 12:00:00", "office")]
    found = {r["region"]: r for r in regional.functions_of(spark.createDataFrame(rows, "region string, u string, t string, c string").withColumn("t", F.to_timestamp("t")), "region", "u", "t", "c").collect()}
    assert set(found) == {"q", "r"} and (found["r"]["activity"], found["r"]["users"], found["r"]["night"], found["r"]["weekend"], found["r"]["function"]) == (2, 1, 1.0, 1.0, "leisure")
    assert found["q"]["workday"] == 0.5 and found["q"]["commercial"] == pytest.approx(0.225 + 0.4) and found["q"]["function"] == "commercial"


def test_pattern_support(spark):
    rows = [("u", "a", 1, 1), ("u", "a", 2, 2), ("u", "b", 3, 3), ("u", None, 4, 4), ("u", "a", 5, 5), ("v", "a", 1, 1), ("v", "b", 1, 2), (None, "a", 1, 1)]
    found = regional.pattern_support(spark.createDataFrame(rows, "u string, p string, t int, o int"), "u", "p", "t", "o", 3, 1)
    assert {(r["pattern"], r["length"], r["support"]) for r in found.collect()} == {("a", 1, 2), ("b", 1, 2), ("a->b", 2, 2), ("b->a", 2, 1), ("a->b->a", 3, 1)}


def test_stages(spark):
    rows = [(15.0, 10.0, 0.0, 0.0, 1), (15.0, 10.0, 0.0, 0.0, 0), (10.0, 10.0, 0.4, 0.2, 0), (7.0, 10.0, 0.9, 0.1, 5), (9.0, 10.0, 0.0, 0.0, 2), (5.0, 0.0, 0.0, 0.0, 3), (1.0, 0.0, 0.5, 0.0, 0)]
    found = spark.createDataFrame(rows, "r double, b double, rn double, bn double, a int").select(regional.stage(F.col("r"), F.col("b"), F.col("rn"), F.col("bn"), F.col("a")).alias("s")).collect()
    assert [r["s"] for r in found] == ["spike_rising", "stable_or_mild", "night_shift_rising", "cooling_down", "volatile", "volatile", "night_shift_rising"]


def test_days_at_the_bound_are_not_out_of_line(spark, tmp_path):
    """Four is the mean and one and a half deviations of these days, whatever their order."""
    counts = [2, 6, 3, 1, 3, 2, 1, 2, 3, 3, 1, 3, 1, 2, 4, 1, 2, 1, 1, 1, 3, 4, 2, 2, 1, 1]
    rows = []
    for user in range(300):
        random.Random(user).shuffle(counts)
        rows += [(user, d * 86400 + 30000 + i, "x") for d, n in enumerate(counts) for i in range(n)]
    made = spark.createDataFrame(rows, "user_id long, s long, event_type string").selectExpr("user_id", "event_type", "timestamp_seconds(s) AS ts")
    made.write.parquet(f"{tmp_path}/events.parquet")
    last = {u: Counter(s // 86400 for v, s, _ in rows if v == u and s // 86400 >= 19) for u in range(300)}
    found = {r["user_id"]: r["anomaly_days"] for r in people.activity_stages(spark, str(tmp_path)).collect()}
    assert found == {u: sum(n > 4 for n in days.values()) for u, days in last.items()}


def test_fused_regions(spark):
    rows = [("r", 1.0, 2, True, 10.0, "a|b", "s"), ("r", None, None, None, None, "b", "s"), ("r", 2.0, 1, False, -4.0, None, "t"), ("q", 0.5, 1, False, None, None, "s"), (None, 9.0, 9, True, 1.0, "x", "s"), ("", 9.0, 9, True, 1.0, "x", "s")]
    df = spark.createDataFrame(rows, "region string, v double, u int, a boolean, c double, k string, s string")
    found = {r["region"]: tuple(r)[1:] for r in regional.fused_regions(df, "region", "v", "u", "a", "c", "k", "s").collect()}
    assert found == {"r": (3.0, 3.0, 3, 1, 3.0, 2, ["b", "a"]), "q": (0.5, 1.0, 1, 0, None, 1, [])}


def test_congestion(spark):
    sections = spark.createDataFrame([(1, "加重"), (1, "加重"), (1, "缓解"), (2, "缓解"), (3, None), (4, "加重"), (4, "缓解"), (None, "加重")], "k int, t string")
    status = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, None), (5, 4), (6, 1)], "k int, status int")
    found = {r["k"]: (r["votes"], r["trend"], r["confidence"]) for r in regional.congestion_trend(sections, "k", "t", status).collect()}
    assert found == {1: (1, "worse", "medium"), 2: (-1, "better", "medium"), 3: (0, "steady_slow", "medium"), 4: (0, "unknown", "low"), 5: (0, "steady_jam", "low"), 6: (0, "steady_free", "low")}


def test_branches(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c", "x"], "n2"), (2, ["a", "b", "c"], "n1"), (3, ["a", "b"], "n0"), (4, None, "n9"), (5, ["a", "b", "c", "y"], "n1")], "k int, p array<string>, n string")
    assert [(r["k"], r["place"]) for r in regional.related_branches(rows, "k", "p", "n", 1).orderBy("place").collect()] == [(2, 1), (5, 2), (1, 3)]
    assert regional.related_branches(rows, "k", "p", "n", 99).collect() == [] and regional.related_branches(rows, "k", "p", "n", 4).collect() == []

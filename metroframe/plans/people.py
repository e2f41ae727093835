"""Queries on raw tables of calls, circles around a subject, scenes of texts, and what regions and days are like."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import circles, onboarding, regional, scene_terms
from ..sources.tables import load
from .activity import events
from .graphs import RELATED, edges
from .registry import registry
from .trajectories import CELLS, cells

QUERIES, ORACLE_SQL, query = registry()

# Raw rows as files have them: numbers with '.0', words for nothing, times that can't be read, some ids hashed already.
RAW = """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN ' nan ' WHEN o_orderkey % 7 = 0 THEN o_custkey || '.0' ELSE ' ' || o_custkey END AS phone, CASE WHEN o_orderkey % 31 = 0 THEN 'NULL' ELSE (o_orderkey // 10)::VARCHAR END AS other,
    CASE WHEN o_orderkey % 13 = 0 THEN upper(md5((o_orderkey % 97)::VARCHAR)) WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey % 97)::VARCHAR END AS device, CASE WHEN o_orderkey % 41 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d 08:30:00') END AS seen_at,
    CASE o_custkey % 5 WHEN 0 THEN 'Fraud' WHEN 1 THEN '正常' WHEN 2 THEN '1.0' WHEN 3 THEN 'what' ELSE '' END AS kind, CASE WHEN o_custkey % 11 = 0 THEN 'Courier' END AS sub FROM orders"""
ROLES = {"phone": "phone", "counterparty": "other", "device": "device", "label": "kind", "sub_label": "sub", "time": "seen_at"}


def raw(spark, folder):
    rows = load(spark, folder, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    return rows.select(
        "o_orderkey", F.when(k % 50 == 0, " nan ").when(k % 7 == 0, F.concat(text(c), F.lit(".0"))).otherwise(F.concat(F.lit(" "), text(c))).alias("phone"),
        F.when(k % 31 == 0, "NULL").otherwise(text(F.floor(k / 10))).alias("other"), F.when(k % 13 == 0, F.upper(F.md5(text(k % 97)))).when(k % 17 == 0, None).otherwise(text(k % 97)).alias("device"),
        F.when(k % 41 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd 08:30:00")).alias("seen_at"),
        F.when(c % 5 == 0, "Fraud").when(c % 5 == 1, "正常").when(c % 5 == 2, "1.0").when(c % 5 == 3, "what").otherwise("").alias("kind"), F.when(c % 11 == 0, "Courier").alias("sub"),
    )


def _clean(c):
    return f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('nan', 'none', 'null', 'nat') THEN '' WHEN regexp_full_match(trim(coalesce({c}, '')), '[0-9]+[.]0') THEN regexp_replace(trim({c}), '[.]0$', '') ELSE trim(coalesce({c}, '')) END"


def _id(c, kind):
    return f"CASE WHEN {_clean(c)} = '' THEN NULL WHEN length({_clean(c)}) IN (16, 32, 40, 64, 96, 128) AND regexp_full_match({_clean(c)}, '[0-9A-Fa-f]+') THEN lower({_clean(c)}) ELSE substr(sha256('{kind}|' || {_clean(c)} || '|salt'), 1, 24) END"


_LABEL = f"CASE WHEN lower({_clean('kind')}) IN ('1', 'fraud') THEN 1 WHEN lower({_clean('kind')}) IN ('0', '正常') THEN 0 ELSE try_cast(try_cast({_clean('kind')} AS DOUBLE) AS INT) END"
_USERS = f"t AS MATERIALIZED (SELECT {_id('phone', 'phone')} AS user_id, {_id('other', 'phone')} AS dst, {_id('device', 'device')} AS imei, {_LABEL} AS label, {_clean('sub')} AS sub, try_cast(seen_at AS TIMESTAMP) AS event_time FROM ({RAW}))"


def _onboarded(spark, folder):
    """SHA-256 instead of the default SHA-512, which the SQL beside it doesn't have; tests have both."""
    return onboarding.onboard(raw(spark, folder), ROLES, "orders", "salt", "orders.parquet", bits=256)


@query(f"SELECT o_orderkey, {_clean('phone')} AS phone, {_clean('other')} AS other, {_clean('device')} AS device FROM ({RAW})")
def cleaned_values(spark, folder):
    return raw(spark, folder).select("o_orderkey", *(onboarding.clean_value(F.col(c)).alias(c) for c in ("phone", "other", "device")))


@query(f"WITH {_USERS} SELECT user_id, label, CASE WHEN sub != '' THEN lower(sub) WHEN label = 1 THEN 'risk' WHEN label = 0 THEN 'normal' ELSE 'unknown' END AS sub_label FROM t WHERE user_id IS NOT NULL")
def onboarded_users(spark, folder):
    return _onboarded(spark, folder)["users"].select("user_id", "label", "sub_label")


@query(f"WITH {_USERS} SELECT user_id AS src_user_id, dst AS dst_counterparty_id, event_time, event_time::DATE AS event_date, hour(event_time)::INT AS event_hour, imei FROM t WHERE user_id IS NOT NULL AND dst IS NOT NULL")
def onboarded_calls(spark, folder):
    return _onboarded(spark, folder)["calls"].select("src_user_id", "dst_counterparty_id", "event_time", "event_date", "event_hour", "imei")


@query(f"WITH {_USERS} SELECT user_id AS src_id, imei AS dst_id, count(*) AS n FROM t WHERE user_id IS NOT NULL AND imei IS NOT NULL GROUP BY 1, 2")
def onboarded_devices(spark, folder):
    return _onboarded(spark, folder)["devices"].groupBy("src_id", "dst_id").agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS rows, count(*) FILTER ({_clean('phone')} = '') AS without_phone, count(*) FILTER ({_clean('other')} = '') AS without_counterpart, count(*) FILTER ({_clean('device')} = '') AS without_device, count(*) FILTER (try_cast(seen_at AS TIMESTAMP) IS NULL) AS broken_times,
    count(*) - count(DISTINCT (phone, other, device, seen_at, kind, sub)) AS repeated FROM ({RAW})""")
def onboarding_quality(spark, folder):
    return onboarding.quality(raw(spark, folder).drop("o_orderkey"), ROLES)


@query(f"""WITH {_USERS}, c AS MATERIALIZED (SELECT user_id, dst, imei FROM t WHERE user_id IS NOT NULL AND dst IS NOT NULL), one AS (SELECT * FROM c WHERE user_id < '8'), two AS (SELECT * FROM c WHERE user_id >= '8'),
    x AS (SELECT least(user_id, dst) AS a, greatest(user_id, dst) AS b FROM one WHERE dst IN (SELECT user_id FROM two) UNION SELECT least(user_id, dst), greatest(user_id, dst) FROM two WHERE dst IN (SELECT user_id FROM one)),
    k AS (SELECT (SELECT count(DISTINCT imei) FROM one WHERE imei IN (SELECT imei FROM two)) AS imei_shared, (SELECT count(DISTINCT dst) FROM one WHERE dst IN (SELECT dst FROM two)) AS dst_counterparty_id_shared, (SELECT count(*) FROM x) AS cross_calls),
    s AS (SELECT *, (imei_shared > 0)::INT + (dst_counterparty_id_shared > 0)::INT + (cross_calls > 0)::INT AS signals, (SELECT (min(length(o.user_id)) != (SELECT min(length(user_id)) FROM two))::INT FROM one o) AS differing_ids FROM k)
    SELECT imei_shared, dst_counterparty_id_shared, cross_calls, signals, differing_ids, CASE WHEN signals >= 2 THEN 'linkable_with_multiple_cross_province_signals' ELSE 'other' END AS level, CASE WHEN signals >= 2 THEN 3 ELSE 0 END AS score FROM s""")
def linkability(spark, folder):
    """Calls of users whose hashed ids begin with 8 to f, against the others, as if they were two provinces."""
    found = _onboarded(spark, folder)["calls"]
    return onboarding.linkability(found.where("src_user_id < '8'"), found.where("src_user_id >= '8'"))


_CIRCLE = f"{RELATED}, z AS (SELECT min(src) AS z FROM e), n1 AS MATERIALIZED (SELECT dst AS node FROM e, z WHERE src = z UNION SELECT src FROM e, z WHERE dst = z UNION SELECT y.member FROM dv x JOIN dv y USING (device), z WHERE x.member = z), nodes AS MATERIALIZED (SELECT z AS node, 0 AS hop FROM z UNION ALL SELECT node, 1 FROM n1, z WHERE node != z)"


def _people(spark, folder):
    calls = edges(spark, folder).select("src", "dst")
    devices = load(spark, folder, "orders").join(load(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("member"), F.col("l_partkey").alias("device"))
    return calls, devices, calls.agg(F.min("src")).first()[0]


@query(f"WITH {_CIRCLE} SELECT node, hop FROM nodes")
def candidate_circle(spark, folder):
    calls, devices, centre = _people(spark, folder)
    return circles.circle(calls, devices, centre, 1)


@query(f"""WITH {_CIRCLE}, cr AS (SELECT y.device, count(*) - 1 AS peers FROM dv x JOIN dv y USING (device), z WHERE x.member = z GROUP BY 1), bd AS (SELECT member AS node, count(*) AS sd, sum(peers)::BIGINT AS sp, sum(ln(1 + peers)) AS st FROM dv JOIN cr USING (device) GROUP BY 1),
    bc AS (SELECT node, count(*) AS cc FROM (SELECT CASE WHEN src = z THEN dst ELSE src END AS node FROM e, z WHERE src = z OR dst = z) GROUP BY 1), cd AS (SELECT node, count(*) AS cd FROM (SELECT unnest([src, dst]) AS node FROM e WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)) GROUP BY 1),
    ov AS (SELECT device, count(*) - 1 AS n FROM dv WHERE member IN (SELECT node FROM nodes) GROUP BY 1), dd AS (SELECT member AS node, sum(n)::BIGINT AS dd FROM dv JOIN ov USING (device) WHERE member IN (SELECT node FROM nodes) GROUP BY 1),
    j AS (SELECT node, coalesce(sd, 0) AS sd, coalesce(sp, 0) AS sp, coalesce(st, 0) AS st, coalesce(cc, 0) AS cc, coalesce(cd, 0) AS cd, coalesce(dd, 0) AS dd FROM nodes LEFT JOIN bd USING (node) LEFT JOIN bc USING (node) LEFT JOIN cd USING (node) LEFT JOIN dd USING (node) WHERE hop > 0)
    SELECT node, sd AS shared_devices, sp AS shared_peers, cc AS calls_with_centre, cd AS call_degree, dd AS device_degree, round(5 * (sd > 0)::INT + 4 * (cc > 0)::INT + 3 * (sd > 0 AND cc > 0)::INT + 2.5::DOUBLE * st + 1.8::DOUBLE * ln(1 + cc) + 1.2::DOUBLE * ln(1 + cd + dd) + 1.5::DOUBLE * (sd >= 2)::INT, 6) AS priority_score FROM j""")
def priority_scores(spark, folder):
    calls, devices, centre = _people(spark, folder)
    return circles.priorities(calls, devices, circles.circle(calls, devices, centre, 1), centre)


SCENES = {
    "writing": {"name": ["the word"], "keywords": ["ther", "ing "], "anti_keywords": ["zzz"], "description": ["and that of"]},
    "travel": {"name": ["que de"], "strong_keywords": ["ción"], "keywords": ["ent"], "anti_keywords": ["th"], "negative_examples": ["what is it"]},
    "numbers": {"strong_keywords": ["12"], "keywords": ["7"], "parameter_options": ["code of value"], "strong_anti_keywords": ["qu"]},
}
_TERMS = ", ".join(f"('{s}', '{t}', {w}::DOUBLE, {p}::DOUBLE)" for s, t, w, p in scene_terms.term_table(SCENES))
_SCENES = f"w(scene, term, weight, penalty) AS (VALUES {_TERMS}), tx AS (SELECT conv_id, turn, lower(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\v\\f]+', '', 'g')) AS text FROM conversations), ss AS (SELECT conv_id, turn, scene, sum(weight) AS weight, sum(penalty) AS penalty FROM tx JOIN w ON contains(text, term) GROUP BY ALL)"
_SCORES = f"{_SCENES}, sc AS (SELECT conv_id, turn, scene, round(weight + penalty, 4) AS points, round(least(0.95::DOUBLE, 0.45::DOUBLE + (weight + penalty) / 10), 2) AS score FROM ss WHERE weight > 0 AND weight + penalty > 0)"


def _scenes(spark, folder):
    rows = load(spark, folder, "conversations").select(F.struct("conv_id", "turn").alias("at"), "text")
    return scene_terms.scene_scores(rows, "at", "text", scene_terms.term_table(SCENES)).select("at.conv_id", "at.turn", "scene", "points", "score")


@query(f"WITH {_SCORES} SELECT * FROM sc")
def scene_scores(spark, folder):
    """What each turn of a conversation is about, by weighted terms."""
    return _scenes(spark, folder)


@query(f"""WITH {_SCORES}, c AS (SELECT conv_id * 1000 + turn AS k, scene, score, scene = 'travel' AS i, score < 0.5 AS r, points >= 7 AS a FROM sc), s AS (SELECT k, arg_min(scene, (-score, scene)) AS f, max(score) AS b FROM c WHERE i AND NOT r GROUP BY 1),
    kp AS (SELECT c.*, f FROM c LEFT JOIN s USING (k) WHERE NOT r AND (coalesce(scene = f, false) OR a OR score >= CASE WHEN f IS NULL THEN 0.65::DOUBLE ELSE greatest(0.65::DOUBLE, b * 0.72::DOUBLE) END)), t AS (SELECT k, arg_min(scene, (-score, scene)) AS t FROM kp GROUP BY 1)
    SELECT k AS turn_id, scene AS skill, score, CASE WHEN scene = coalesce(f, t) THEN 'primary' ELSE 'supporting' END AS role FROM kp JOIN t USING (k)""")
def resolved_scenes(spark, folder):
    """Of each turn's scenes, the one that answers, and those that support it."""
    found = _scenes(spark, folder).select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("scene").alias("skill"), "score", (F.col("scene") == "travel").alias("in_scene"), (F.col("score") < 0.5).alias("refused"), (F.col("points") >= 7).alias("asked_for"))
    return scene_terms.resolved(found, "turn_id")


_KINDS = "CASE event_type WHEN 'purchase' THEN '[\"Shopping Mall\", \"bank\"]' WHEN 'view' THEN 'museum; park' WHEN 'click' THEN 'Metro|house' ELSE 'residential' END"


@query(f"""WITH p AS (SELECT cell, user_id, hour(ts) AS h, isodow(ts) AS d, {_KINDS} AS kind FROM ({CELLS})),
    k AS (SELECT *, CASE kind WHEN 'museum; park' THEN 2 WHEN 'Metro|house' THEN 2 WHEN 'residential' THEN 1 ELSE 2 END AS c, (kind = 'residential')::INT AS r, CASE WHEN kind LIKE '[%' THEN 2 ELSE 0 END AS m, (kind = 'Metro|house')::INT AS t, CASE WHEN kind LIKE '[%' THEN 1 WHEN kind = 'museum; park' THEN 2 ELSE 0 END AS l FROM p),
    g AS (SELECT cell AS region, count(*) AS activity, count(DISTINCT user_id) AS users, count(*) FILTER (h BETWEEN 6 AND 9) / count(*)::DOUBLE AS morning, count(*) FILTER (h BETWEEN 10 AND 16) / count(*)::DOUBLE AS workday, count(*) FILTER (h BETWEEN 17 AND 21) / count(*)::DOUBLE AS evening, count(*) FILTER (h < 6 OR h >= 22) / count(*)::DOUBLE AS night,
        count(*) FILTER (d >= 6) / count(*)::DOUBLE AS weekend, sum(r) / sum(c)::DOUBLE AS wr, sum(m) / sum(c)::DOUBLE AS wm, sum(t) / sum(c)::DOUBLE AS wt, sum(l) / sum(c)::DOUBLE AS wl FROM k GROUP BY 1),
    s AS (SELECT *, 0.45 * night + 0.2 * weekend + 0.35 * wr AS residential, 0.45 * workday + 0.15 * evening + 0.4 * wm AS commercial, 0.5 * morning + 0.5 * evening + 0.5 * wt AS transit, 0.35 * evening + 0.35 * night + 0.15 * weekend + 0.5 * wl AS leisure FROM g),
    o AS (SELECT *, list_sort([{{'n': -residential, 'i': 0, 'f': 'residential'}}, {{'n': -commercial, 'i': 1, 'f': 'commercial'}}, {{'n': -transit, 'i': 2, 'f': 'transit'}}, {{'n': -leisure, 'i': 3, 'f': 'leisure'}}]) AS o FROM s)
    SELECT region, activity, users, {', '.join(f'round({c}, 6) AS {c}' for c in ('morning', 'workday', 'evening', 'night', 'weekend', 'residential', 'commercial', 'transit', 'leisure'))}, CASE WHEN o[2].n - o[1].n < 0.08 THEN 'mixed' ELSE o[1].f END AS function FROM o""")
def region_functions(spark, folder):
    """What cells are used for, by their hours and the kinds of what is done there."""
    kind = F.when(F.col("event_type") == "purchase", '["Shopping Mall", "bank"]').when(F.col("event_type") == "view", "museum; park").when(F.col("event_type") == "click", "Metro|house").otherwise("residential")
    found = regional.functions_of(cells(spark, folder).withColumn("kind", kind), "cell", "user_id", "ts", "kind")
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


@query("""WITH o AS (SELECT user_id AS u, event_type AS p, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), k AS (SELECT * FROM o WHERE b IS NULL OR b != p), a AS (SELECT u, p, lead(p) OVER w AS q, lead(p, 2) OVER w AS r FROM k WINDOW w AS (PARTITION BY u ORDER BY ts, event_id)),
    m AS (SELECT u, p AS pattern, 1 AS length FROM a UNION SELECT u, p || '->' || q, 2 FROM a WHERE q IS NOT NULL UNION SELECT u, p || '->' || q || '->' || r, 3 FROM a WHERE r IS NOT NULL) SELECT pattern, length, count(*) AS support FROM m GROUP BY 1, 2 HAVING count(*) >= 5""")
def pattern_support(spark, folder):
    """Which kinds of events follow each other, by how many users do so."""
    return regional.pattern_support(events(spark, folder), "user_id", "event_type", "ts", "event_id", 3, 5)


@query("""WITH l AS (SELECT max(ts::DATE) AS l FROM events), d AS (SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 6) AS t FROM events GROUP BY 1, 2), s AS (SELECT user_id, avg(n) AS m, stddev_pop(n) AS sd FROM d GROUP BY 1),
    g AS (SELECT user_id, sum(n) FILTER (day > l - 7) / 7::DOUBLE AS r, sum(n) FILTER (day <= l - 7) / 21::DOUBLE AS b, sum(t) FILTER (day > l - 7) / nullif(sum(n) FILTER (day > l - 7), 0)::DOUBLE AS rn, sum(t) FILTER (day <= l - 7) / nullif(sum(n) FILTER (day <= l - 7), 0)::DOUBLE AS bn, count(*) FILTER (day > l - 7 AND n > m + 1.5 * sd) AS a FROM d JOIN s USING (user_id), l WHERE day > l - 28 GROUP BY 1),
    c AS (SELECT user_id, coalesce(r, 0) AS r, coalesce(b, 0) AS b, coalesce(rn, 0) AS rn, coalesce(bn, 0) AS bn, a FROM g)
    SELECT user_id, round(r, 6) AS recent, round(b, 6) AS baseline, a AS anomaly_days, CASE WHEN b != 0 AND 100 * (r - b) / b >= 50 AND a >= 1 THEN 'spike_rising' WHEN rn - bn >= 0.15 AND r >= b THEN 'night_shift_rising' WHEN b != 0 AND 100 * (r - b) / b <= -30 THEN 'cooling_down' WHEN a >= 2 THEN 'volatile' ELSE 'stable_or_mild' END AS stage FROM c""")
def activity_stages(spark, folder):
    """Each user's last week against the three before it."""
    rows = events(spark, folder)
    last = rows.agg(F.max(F.to_date("ts"))).first()[0]
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 6)
    days = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(night).alias("t"))
    n = F.col("n").cast("decimal(19,0)")
    usual = days.groupBy("user_id").agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum((n * n).cast("decimal(28,0)")).alias("q"))
    recent = F.date_diff(F.lit(last), F.col("day")) < 7
    part = lambda c, flag: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0))
    share = lambda flag: F.coalesce(F.try_divide(part("t", flag), part("n", flag)), F.lit(0.0))
    found = days.where(F.date_diff(F.lit(last), F.col("day")) < 28).join(usual, "user_id").groupBy("user_id").agg(
        (part("n", recent) / 7).alias("r"), (part("n", ~recent) / 21).alias("b"), share(recent).alias("rn"), share(~recent).alias("bn"), F.count_if(recent & regional.out_of_line(F.col("n"), F.col("k"), F.col("s"), F.col("q"))).alias("a"))
    return found.select("user_id", F.round("r", 6).alias("recent"), F.round("b", 6).alias("baseline"), F.col("a").alias("anomaly_days"), regional.stage(F.col("r"), F.col("b"), F.col("rn"), F.col("bn"), F.col("a")).alias("stage"))


_EVIDENCE = f"SELECT cell, user_id, value, event_id % 40 = 0 AS odd, CASE WHEN event_id % 3 = 0 THEN (event_id % 21) - 10 END AS change, 's' || event_id % 4 AS source, {_KINDS} AS kind FROM ({CELLS})"
_PARSED = "CASE WHEN kind LIKE '[%' THEN ['Shopping Mall', 'bank'] WHEN kind = 'museum; park' THEN ['museum', 'park'] WHEN kind = 'Metro|house' THEN ['Metro', 'house'] ELSE ['residential'] END"


def _evidence(spark, folder):
    kind = F.when(F.col("event_type") == "purchase", '["Shopping Mall", "bank"]').when(F.col("event_type") == "view", "museum; park").when(F.col("event_type") == "click", "Metro|house").otherwise("residential")
    e = F.col("event_id")
    return cells(spark, folder).select("cell", "user_id", "value", (e % 40 == 0).alias("odd"), F.when(e % 3 == 0, e % 21 - 10).alias("change"), F.concat(F.lit("s"), e % 4).alias("source"), kind.alias("kind"))


@query(f"""WITH e AS ({_EVIDENCE}), c AS (SELECT cell, k, count(*) AS n FROM (SELECT cell, unnest({_PARSED}) AS k FROM e) GROUP BY 1, 2), t AS (SELECT cell, list(k ORDER BY n DESC, k)[1:5] AS top_categories FROM c GROUP BY 1)
    SELECT e.cell AS region, round(sum(value), 2) AS visits, round(sum(user_id), 2)::DOUBLE AS users, count(*) AS n_evidence, count(*) FILTER (odd) AS anomalies, round(avg(change), 2) AS mean_change, count(DISTINCT source) AS n_sources, any_value(top_categories) AS top_categories FROM e JOIN t USING (cell) GROUP BY 1""")
def fused_regions(spark, folder):
    return regional.fused_regions(_evidence(spark, folder), "cell", "value", "user_id", "odd", "change", "kind", "source")


@query(f"WITH e AS ({_EVIDENCE}) SELECT cell AS region, k AS category, count(*) AS n FROM (SELECT cell, unnest({_PARSED}) AS k FROM e) GROUP BY 1, 2")
def region_categories(spark, folder):
    rows = _evidence(spark, folder)
    return regional.category_counts(rows.withColumn("parsed", regional.categories(F.col("kind"))), "cell", "parsed")


@query("""WITH v AS (SELECT l_suppkey, sum(CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE 0 END)::BIGINT AS votes, count(*) AS sections FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), s AS (SELECT s_suppkey, s_suppkey % 6 AS status FROM supplier), j AS (SELECT s_suppkey, status, coalesce(votes, 0) AS votes, coalesce(sections, 0) AS sections FROM s LEFT JOIN v ON l_suppkey = s_suppkey)
    SELECT s_suppkey AS road, votes, sections, CASE WHEN votes > 0 THEN 'worse' WHEN votes < 0 THEN 'better' WHEN status IN (3, 4) THEN 'steady_jam' WHEN status = 2 THEN 'steady_slow' WHEN status = 1 THEN 'steady_free' ELSE 'unknown' END AS trend,
    CASE WHEN votes != 0 THEN 'medium' WHEN status IN (2, 3, 4) AND sections > 0 THEN 'medium' ELSE 'low' END AS confidence FROM j""")
def congestion_trends(spark, folder):
    """Suppliers as roads, their lines as sections."""
    part = F.col("l_partkey") % 5
    trend = F.when(part.isin(0, 2), regional.WORSE).when(part.isin(1, 3), regional.BETTER)
    sections = load(spark, folder, "lineitem").where("l_linenumber <= 2").select(F.col("l_suppkey").alias("road"), trend.alias("trend"))
    status = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("road"), (F.col("s_suppkey") % 6).alias("status"))
    return regional.congestion_trend(sections, "road", "trend", status)


@query("WITH o AS (SELECT p_type FROM part ORDER BY p_partkey LIMIT 1) SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey)::INT AS place FROM part WHERE string_split(p_type, ' ')[1:3] = (SELECT string_split(p_type, ' ')[1:3] FROM o)")
def related_branches(spark, folder):
    """Parts of the same type as the first one."""
    rows = load(spark, folder, "part").withColumn("path", F.split("p_type", " "))
    return regional.related_branches(rows, "p_partkey", "path", "p_name", rows.agg(F.min("p_partkey")).first()[0])

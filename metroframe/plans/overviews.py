"""Queries that sum up tables of subjects, calls and devices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overview, risk
from ..sources.tables import load
from .registry import registry
from .risk import CALLS, DEVICES, FEATURES, MEMBERS, RISK, SUBJECTS, _risk, calls, members, subjects

QUERIES, ORACLE_SQL, query = registry()
NIGHT = "(hour(ts) >= 22 OR hour(ts) < 6)"


@query(f"""WITH {SUBJECTS}, a AS (SELECT count(*) AS rows, count(DISTINCT id) AS d FROM subjects), m AS (SELECT 'rows' AS measure, '' AS value, rows AS n FROM a UNION ALL SELECT 'distinct', '', d FROM a UNION ALL SELECT 'duplicates', '', rows - d FROM a
    UNION ALL SELECT 'province', province, count(*) FROM subjects GROUP BY 2 UNION ALL SELECT 'label', label::VARCHAR, count(*) FROM subjects GROUP BY 2 UNION ALL SELECT 'sub_label', sub_label, count(*) FROM subjects GROUP BY 2) SELECT measure, value, n, round(n / rows::DOUBLE, 6) AS share FROM m, a""")
def node_overview(spark, folder):
    return overview.node_overview(subjects(spark, folder), "id", ["province", "label", "sub_label"])


@query(f"""WITH {CALLS} SELECT count(*) AS records, sum(duration) AS weight, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, min(ts) AS first, max(ts) AS last, round(avg({NIGHT}::INT), 6) AS night_ratio,
    round(count(DISTINCT ts::DATE) / (date_diff('day', min(ts::DATE), max(ts::DATE)) + 1)::DOUBLE, 6) AS active_ratio FROM calls""")
def full_call_overview(spark, folder):
    made = overview.call_overview(calls(spark, folder))
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


_TOP = "SELECT '{0}' AS side, {1} AS id, count(*) AS records, sum(duration) AS weight, count(DISTINCT {2}) AS others, round(avg(" + NIGHT + "::INT), 6) AS night_ratio FROM calls GROUP BY {1} ORDER BY records DESC, {1} LIMIT 20"


@query(f"WITH {CALLS} SELECT * FROM ({_TOP.format('source', 'src', 'dst')}) UNION ALL SELECT * FROM ({_TOP.format('target', 'dst', 'src')})")
def top_callers(spark, folder):
    rows = calls(spark, folder)
    a, b = overview.top_ends(rows, "src", "dst", 20), overview.top_ends(rows, "dst", "src", 20)
    return a.select(F.lit("source").alias("side"), "*").union(b.select(F.lit("target"), "*"))


@query(f"WITH {CALLS} SELECT ts::DATE AS day, count(*) AS records, sum(duration) AS weight, count(DISTINCT src) AS sources, round(avg({NIGHT}::INT), 6) AS night_ratio FROM calls GROUP BY 1")
def call_days(spark, folder):
    night = risk.is_night(F.col("ts")).cast("double")
    return calls(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("records"), F.sum("duration").alias("weight"), F.count_distinct("src").alias("sources"), F.round(F.avg(night), 6).alias("night_ratio"))


@query(f"""WITH {CALLS}, {SUBJECTS}, u AS (SELECT DISTINCT src, device FROM calls), s AS (SELECT device, count(*) AS users, count(*) FILTER {RISK.replace('(label', '(WHERE label')} AS risky, array_to_string(list_slice(list_sort(list(src)), 1, 10), ', ') AS first_users FROM u LEFT JOIN subjects ON id = src GROUP BY 1)
    SELECT * FROM s ORDER BY users DESC, device LIMIT 5""")
def top_devices(spark, folder):
    return overview.top_devices(calls(spark, folder), subjects(spark, folder), _risk(), 5)


def _artifact_sql(item, least):
    return f"""WITH {CALLS}, {SUBJECTS}, u AS (SELECT DISTINCT src, {item} FROM calls) SELECT {item}, count(*) FILTER (src % 10 = 0 AND src IN (SELECT id FROM subjects)) AS members, count(*) AS users, count(*) FILTER {RISK.replace('(label', '(WHERE label')} AS risky,
    coalesce(string_agg(DISTINCT province, ', ' ORDER BY province), '') AS provinces, array_to_string(list_slice(list_sort(list(src) FILTER (src % 10 = 0)), 1, 5), ', ') AS preview FROM u LEFT JOIN subjects ON id = src GROUP BY 1 HAVING members >= {least}"""


@query(_artifact_sql("device", 1))
def device_artifact(spark, folder):
    return overview.item_artifact(calls(spark, folder), members(spark, folder), subjects(spark, folder), "device", _risk(), 1)


@query(_artifact_sql("dst", 2))
def counterpart_artifact(spark, folder):
    return overview.item_artifact(calls(spark, folder), members(spark, folder), subjects(spark, folder), "dst", _risk(), 2)


@query(f"WITH {CALLS}, u AS (SELECT DISTINCT src, device FROM calls) SELECT src AS id, count(*) AS shared_devices FROM u WHERE device IN (SELECT device FROM u WHERE src IN (10, 20, 30)) AND src NOT IN (10, 20, 30) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def candidate_expansion(spark, folder):
    return overview.expansion(calls(spark, folder), spark.range(10, 40, 10), 25)


@query(f"""WITH {FEATURES}, r AS (SELECT id, false AS is_seed FROM features WHERE id NOT IN (10, 20, 30) ORDER BY 10 * devices + 3 * counterparties DESC, id LIMIT 17) SELECT id, true AS is_seed FROM (SELECT unnest([10, 20, 30]) AS id) UNION ALL SELECT * FROM r""")
def trimmed_circle(spark, folder):
    feats = risk.features(calls(spark, folder), subjects(spark, folder)).withColumnRenamed("counterparties", "counterparts")
    return overview.trimmed_circle(feats, spark.range(10, 40, 10), 20)


@query(f"WITH {CALLS}, {MEMBERS} SELECT src AS id, count(*) AS records, count(DISTINCT dst) AS counterparts, count(*) FILTER (dst IN (FROM members)) AS internal_calls, count(DISTINCT dst) FILTER (dst IN (FROM members)) AS internal_counterparts FROM calls WHERE src IN (FROM members) GROUP BY 1")
def group_calls(spark, folder):
    return overview.group_calls(calls(spark, folder), members(spark, folder))


@query(f"""WITH {FEATURES}, {MEMBERS}, o AS (SELECT *, count(*) OVER (PARTITION BY device) AS k FROM de WHERE src IN (FROM members)) SELECT src AS id, count(*) AS devices, count(*) FILTER (users >= 2) AS shared, count(*) FILTER (users >= 3) AS pools_3, count(*) FILTER (users >= 5) AS pools_5,
    count(*) FILTER (users >= 10) AS pools_10, count(*) FILTER (k >= 2) AS in_group, sum(k - 1)::BIGINT AS group_peers, max(users) AS largest_pool, sum(users - 1)::BIGINT AS peers FROM o GROUP BY 1""")
def group_devices(spark, folder):
    return overview.group_devices(calls(spark, folder), members(spark, folder))


@query(f"""WITH {CALLS}, {SUBJECTS}, j AS (SELECT * FROM calls JOIN subjects ON id = src), a AS (SELECT province, count(DISTINCT src) AS callers, count(*) AS records, sum(duration) AS weight, count(DISTINCT dst) AS targets, count(*) FILTER {NIGHT.replace('(hour', '(WHERE hour')} AS night_calls, avg(duration) AS md,
    count(DISTINCT ts::DATE) AS active_days, (date_diff('day', min(ts::DATE), max(ts::DATE)) + 1)::INT AS calendar_days FROM j GROUP BY 1) SELECT province, callers, records, weight, targets, night_calls, round(night_calls / records::DOUBLE, 4) AS night_ratio, round(records / callers::DOUBLE, 4) AS records_per_caller,
    round(md, 4) AS mean_duration, active_days, calendar_days, round(records / calendar_days::DOUBLE, 4) AS records_per_day, round(records / calendar_days::DOUBLE / callers, 4) AS records_per_day_and_caller FROM a""")
def call_behaviour(spark, folder):
    return overview.behaviour(calls(spark, folder), subjects(spark, folder), "province")


@query(f"""WITH {DEVICES}, pd AS (SELECT DISTINCT province, device FROM u JOIN subjects USING (id)) SELECT province, count(*) AS devices, count(*) FILTER (users >= 2) AS at_least_2, count(*) FILTER (users >= 5) AS at_least_5, count(*) FILTER (users >= 10) AS at_least_10, count(*) FILTER (provinces > 1) AS across,
    round(avg(risk_ratio), 6) AS mean_risk_ratio FROM pd JOIN devices USING (device) GROUP BY 1""")
def device_summary(spark, folder):
    rows, own = calls(spark, folder), subjects(spark, folder)
    used = rows.select(F.col("src").alias("id"), "device").distinct().join(own, "id")
    return overview.device_summary(risk.device_scores(rows, own, _risk()), used, "province")


@query(f"WITH {FEATURES} SELECT round(avg(counterparties), 6) AS mean, median(counterparties)::DOUBLE AS median, quantile_cont(counterparties, 0.9)::DOUBLE AS p90, round(avg((counterparties >= 10)::INT), 6) AS over_0, round(avg((counterparties >= 50)::INT), 6) AS over_1 FROM features")
def structure_metrics(spark, folder):
    return overview.structure(risk.features(calls(spark, folder), subjects(spark, folder)), "counterparties", [10, 50])


@query("SELECT length(p_brand || p_size) AS length, count(*) AS n, count(*) FILTER (regexp_full_match(p_brand || p_size, '[0-9a-fA-F]+')) AS hex, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM part GROUP BY 1")
def id_lengths(spark, folder):
    made = overview.id_formats(load(spark, folder, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("id")), "id")
    return made.withColumn("length", F.col("length").cast("long"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN text END AS text, CASE WHEN doc_id % 2 > 0 THEN lang END AS lang, source FROM documents), c AS (SELECT 'text' AS "check", round(1 - count(text) / count(*)::DOUBLE, 6) AS value, 0.05 AS w, 0.3 AS f FROM d UNION ALL SELECT 'lang', round(1 - count(lang) / count(*)::DOUBLE, 6), 0.05, 0.3 FROM d
    UNION ALL SELECT 'source', round(1 - count(source) / count(*)::DOUBLE, 6), 0.05, 0.3 FROM d) SELECT "check", value, CASE WHEN value > f THEN 'fail' WHEN value > w THEN 'warn' ELSE 'pass' END AS status FROM c UNION ALL SELECT 'doc_id repeats', (count(*) - count(DISTINCT doc_id))::DOUBLE, CASE WHEN count(*) > count(DISTINCT doc_id) THEN 'fail' ELSE 'pass' END FROM d""")
def table_checks(spark, folder):
    d = F.col("doc_id")
    made = load(spark, folder, "documents").select("doc_id", F.when(d % 10 > 0, F.col("text")).alias("text"), F.when(d % 2 > 0, F.col("lang")).alias("lang"), "source")
    return overview.quality_checks(made, "doc_id", {c: (0.05, 0.3) for c in ("text", "lang", "source")})


@query(f"WITH {DEVICES} SELECT province, device, users, risky, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY province ORDER BY users DESC, risky DESC, device) AS rank FROM (SELECT DISTINCT province, device FROM u JOIN subjects USING (id)) JOIN devices USING (device)) WHERE rank <= 3")
def top_devices_by_province(spark, folder):
    rows, own = calls(spark, folder), subjects(spark, folder)
    scores = risk.device_scores(rows, own, _risk()).drop("province")
    used = rows.select(F.col("src").alias("id"), "device").distinct().join(own, "id").select("province", "device").distinct()
    return overview.ranked_within(used.join(scores, "device"), "province", [F.desc("users"), F.desc("risky"), F.col("device")], 3).select("province", "device", "users", "risky", "rank")


@query("SELECT user_id, arg_min(v, (-p, event_id)) AS value, arg_min(event_type, (-p, event_id)) AS event_type FROM (SELECT *, event_id % 3 AS p, CASE WHEN event_id % 4 > 0 THEN value END AS v FROM events) GROUP BY 1")
def first_known_values(spark, folder):
    e = F.col("event_id")
    made = load(spark, folder, "events").select("user_id", "event_type", "event_id", F.when(e % 4 > 0, F.col("value")).alias("value"), (e % 3).alias("priority"))
    return overview.first_known(made, "user_id", [-F.col("priority"), F.col("event_id")], ["value", "event_type"])


@query("""WITH n AS (SELECT conv_id, turn, trim(text) AS t, trim(lower(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS n FROM conversations), o AS (SELECT conv_id, arg_min(t, turn) AS t, min(turn) AS turn FROM n WHERE n != '' GROUP BY conv_id, n)
    SELECT conv_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest FROM o GROUP BY 1""")
def united_texts(spark, folder):
    return overview.united_text(load(spark, folder, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"))


@query("SELECT p_brand, count(*) AS n, round(sum(p_size), 4)::DOUBLE AS total, round(avg(p_size), 4) AS mean, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1")
def property_statistics(spark, folder):
    made = overview.aggregated(load(spark, folder, "part"), "p_brand", "p_size")
    return made.withColumn("total", F.col("total").cast("double"))


@query("SELECT count(*) AS n, coalesce(sum(v), 0)::DOUBLE AS total, round(avg(v), 4) AS mean, max(v)::INT AS most, min(v)::INT AS least FROM (SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS v FROM events) WHERE v IS NOT NULL")
def nested_statistics(spark, folder):
    """Measures of a value inside JSON; rows without it don't count."""
    value = F.get_json_object("props", "$.k").try_cast("int")
    made = load(spark, folder, "events").select(value.alias("v")).where("v is not null")
    return made.agg(F.count("*").alias("n"), F.coalesce(F.sum("v").cast("double"), F.lit(0.0)).alias("total"), F.round(F.avg("v"), 4).alias("mean"), F.max("v").alias("most"), F.min("v").alias("least"))


@query("SELECT count(*) AS n, count(DISTINCT url) AS n_urls, count(*) FILTER (length(html) > 1000) AS long_pages, count(*) FILTER (html LIKE '%<script%') AS with_scripts, max(page_id) AS last FROM pages")
def crawl_statistics(spark, folder):
    return load(spark, folder, "pages").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"), F.count_if(F.length("html") > 1000).alias("long_pages"), F.count_if(F.col("html").contains("<script")).alias("with_scripts"), F.max("page_id").alias("last"))


@query(f"WITH {CALLS} SELECT src, device, hour(ts)::INT AS hour, count(*) AS edges, sum(duration) AS weight FROM calls GROUP BY 1, 2, 3")
def device_rollup(spark, folder):
    return calls(spark, folder).groupBy("src", "device", F.hour("ts").alias("hour")).agg(F.count("*").alias("edges"), F.sum("duration").alias("weight"))


@query(f"WITH {CALLS}, {SUBJECTS}, d AS (SELECT src AS id, arg_min(province, (-n, province)) AS p2 FROM (SELECT c.src, s.province, count(*) AS n FROM calls c JOIN subjects s ON s.id = c.dst GROUP BY 1, 2) GROUP BY 1), n AS (SELECT id, province FROM subjects WHERE id % 3 = 0) SELECT coalesce(n.id, d.id) AS id, coalesce(province, p2) AS province FROM n FULL JOIN d ON n.id = d.id")
def merged_provinces(spark, folder):
    """A subject's province, or where it has no profile, that of most of its calls."""
    own = subjects(spark, folder)
    counted = calls(spark, folder).join(own.select(F.col("id").alias("dst"), "province"), "dst").groupBy(F.col("src").alias("id"), "province").agg(F.count("*").alias("n"))
    derived = counted.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "province")).alias("b")).select("id", F.col("b.province").alias("province"))
    return overview.merged_sources(own.where("id % 3 = 0").select("id", "province"), derived, "id", ["province"])


@query(f"WITH {CALLS} SELECT device FROM calls WHERE src = 10 INTERSECT SELECT device FROM calls WHERE src = 20")
def common_devices(spark, folder):
    return overview.all_of(calls(spark, folder), "src", "device", [10, 20])


@query(f"WITH {CALLS}, {SUBJECTS} SELECT id FROM subjects EXCEPT SELECT src FROM calls WHERE duration >= 50")
def control_group(spark, folder):
    """All subjects but those treated."""
    treated = calls(spark, folder).where("duration >= 50").select(F.col("src").alias("id"))
    return subjects(spark, folder).select("id").distinct().join(treated, "id", "left_anti")

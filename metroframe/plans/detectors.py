"""Queries for anomalies in the daily counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detectors, series
from ..sources.tables import load
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
SERIES = """s AS (SELECT unique_id, ds, coalesce(y, 0) AS y FROM (SELECT unique_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY))::DATE AS ds FROM (SELECT event_type AS unique_id, ts::DATE AS ds FROM events) GROUP BY 1)
    LEFT JOIN (SELECT event_type AS unique_id, ts::DATE AS ds, count(*) AS y FROM events GROUP BY 1, 2) USING (unique_id, ds))"""
MEASURES = """m AS (SELECT unique_id, ds, y, round(y - CASE WHEN count(*) OVER p3 = 3 THEN median(y) OVER p3 END, 6) AS persist, round(y - avg(y) OVER (PARTITION BY unique_id, place), 6) AS seasonal,
    round(abs(CASE WHEN count(*) OVER n6 = 6 THEN median(y) OVER n6 END - CASE WHEN count(*) OVER p6 = 6 THEN median(y) OVER p6 END), 6) AS level_shift,
    round(abs(CASE WHEN count(*) OVER n6 = 6 THEN stddev_samp(y) OVER n6 END - d) / CASE WHEN d > 0 THEN d END, 6) AS volatility_shift
    FROM (SELECT *, (row_number() OVER w - 1) % 7 AS place, CASE WHEN count(*) OVER p6 = 6 THEN stddev_samp(y) OVER p6 END AS d FROM s WINDOW w AS (PARTITION BY unique_id ORDER BY ds), p6 AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
    WINDOW p3 AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), p6 AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), n6 AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))"""


def _hit(name: str, c: float, both: bool) -> str:
    q = lambda p: f"quantile_cont({name}, {p}) OVER (PARTITION BY unique_id)"
    above = f"{name} > round({q(0.75)} + {c}::DOUBLE * ({q(0.75)} - {q(0.25)}), 6)"
    return f"coalesce({above}{f' OR {name} < round({q(0.25)} - {c}::DOUBLE * ({q(0.75)} - {q(0.25)}), 6)' if both else ''}, false) AS {name}"


NAMES = ["persist", "level_shift", "volatility_shift", "seasonal", "threshold"]
HITS = f"h AS (SELECT unique_id, ds, y, {_hit('persist', 1.5, True)}, {_hit('level_shift', 1.5, False)}, {_hit('volatility_shift', 1.5, False)}, {_hit('seasonal', 1.5, True)}, y > 60 AS threshold FROM m)"


def detected(spark, folder) -> DataFrame:
    rows = series.daily(load(spark, folder, "events"), "event_type", "ts")
    rows = detectors.volatility_shift(detectors.level_shift(detectors.persist(rows, 3, 1.5), 6, 1.5), 6, 1.5)
    return detectors.threshold(detectors.seasonal(rows, 7, 1.5), high=60)


@query(f"WITH {SERIES}, {MEASURES}, {HITS} SELECT * FROM h WHERE persist OR level_shift OR volatility_shift OR seasonal OR threshold")
def detected_anomalies(spark, folder):
    return detected(spark, folder).where(" OR ".join(NAMES))


@query(f"""WITH {SERIES}, {MEASURES}, {HITS}, o AS (SELECT *, persist OR level_shift OR volatility_shift OR seasonal OR threshold AS hit FROM h), p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY unique_id ORDER BY ds) AS place FROM o)
    SELECT unique_id, count(*) AS points, count(*) FILTER (hit) AS anomalies, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate, {', '.join(f'count(*) FILTER ({n}) AS n_{n}' for n in NAMES)},
    coalesce(string_agg(strftime(ds, '%Y-%m-%d'), ',' ORDER BY ds) FILTER (hit AND place <= 5), '') AS first_days FROM p GROUP BY 1""")
def anomaly_report(spark, folder):
    return detectors.report(detected(spark, folder), NAMES, 5)


@query(f"""WITH {SERIES}, t AS (SELECT *, max(ds) OVER (PARTITION BY unique_id) AS last FROM s), f AS (SELECT unique_id, ds, last, y, lag(y, 7) OVER w AS season, lag(y, 14) OVER w AS second FROM t WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
    e AS (SELECT unique_id, unnest(['seasonal', 'mean of seasons']) AS model, y, unnest([season::DOUBLE, (season + second) / 2.0::DOUBLE]) AS forecast FROM f WHERE date_diff('day', ds, last) < 7 AND second IS NOT NULL),
    r AS (SELECT unique_id, model, round(avg(CASE WHEN abs(y) + abs(forecast) > 0 THEN 2.0::DOUBLE * abs(y - forecast) / (abs(y) + abs(forecast)) ELSE 0 END) * 100, 6) AS smape FROM e GROUP BY 1, 2)
    SELECT unique_id, arg_min(model, (smape, model)) AS model, min(smape) AS smape FROM r GROUP BY 1""")
def selected_models(spark, folder):
    """The better of two forecasts over the last week: one season before, or the mean of two."""
    from pyspark.sql import Window

    w = Window.partitionBy("unique_id").orderBy("ds")
    rows = series.daily(load(spark, folder, "events"), "event_type", "ts").withColumn("last", F.max("ds").over(Window.partitionBy("unique_id")))
    lagged = rows.withColumn("season", F.lag("y", 7).over(w)).withColumn("second", F.lag("y", 14).over(w)).where("date_diff(last, ds) < 7 AND second IS NOT NULL")
    made = F.array(F.struct(F.lit("seasonal").alias("model"), F.col("season").cast("double").alias("forecast")), F.struct(F.lit("mean of seasons").alias("model"), ((F.col("season") + F.col("second")) / 2.0).alias("forecast")))
    return detectors.best_model(lagged.select("unique_id", "y", F.explode(made).alias("f")).select("unique_id", "y", "f.*"))

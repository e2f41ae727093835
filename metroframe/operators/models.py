"""Models that are fitted on the executors: Holt-Winters forecasts, k-means, principal components.

What comes to the driver is of the model's own size: centres, or a matrix as wide as a row is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .ranks import quantiles

#: Features of a row, at most, whose products are summed; the driver holds a square of it.
WIDEST = 1000


def holt_winters(y: Column, season: int, horizon: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2) -> Column:
    """Forecasts (array of horizon doubles, not below 0) of a series in order (array<double>, not empty) by level, trend and additive season.

    A series of less than two seasons, or a season of less than two steps, is smoothed exponentially, and its last level is the forecast.
    The season begins as the mean of each of its steps in the whole seasons less that of all; the trend, as the mean step between the first two seasons."""
    place = lambda i: (i % season) + 1
    mean = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    smoothed = F.aggregate(y, F.element_at(y, 1), lambda s, x: alpha * x + (1 - alpha) * s)
    simple = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(F.lit(0.0), smoothed))
    if season < 2:
        return simple
    whole = F.floor(F.size(y) / season)
    overall = mean(F.slice(y, F.lit(1), (whole * season).cast("int")))
    steps = lambda k: F.transform(F.sequence(F.lit(0), whole.cast("int") - 1), lambda i: F.element_at(y, (k + i * season + 1).cast("int")))
    seasonal = F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda k: mean(steps(k)) - overall)
    total = lambda first: F.aggregate(F.slice(y, first, season), F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(0).alias("i"), (total(1) / season).alias("level"), ((total(season + 1) - total(1)) / (season * season)).alias("trend"), seasonal.alias("seasonal"))

    def step(s: Column, x: Column) -> Column:
        own = F.element_at(s["seasonal"], place(s["i"]))
        level = alpha * (x - own) + (1 - alpha) * (s["level"] + s["trend"])
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        season_now = F.transform(s["seasonal"], lambda v, k: F.when(k == s["i"] % season, gamma * (x - level) + (1 - gamma) * v).otherwise(v))
        moved = F.struct((s["i"] + 1).alias("i"), level.alias("level"), trend.alias("trend"), season_now.alias("seasonal"))
        return F.when(s["i"] == 0, F.struct(F.lit(1).alias("i"), s["level"].alias("level"), s["trend"].alias("trend"), s["seasonal"].alias("seasonal"))).otherwise(moved)

    ahead = lambda s: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.greatest(F.lit(0.0), s["level"] + h * s["trend"] + F.element_at(s["seasonal"], place(s["i"] + h - 1))))
    seasonal_forecast = F.aggregate(y, start, step, ahead)
    return F.when(F.size(y) < 2 * season, simple).otherwise(seasonal_forecast)


def region_forecasts(counts: DataFrame, season: int = 7, horizon: int = 3, history: int = 7) -> DataFrame:
    """(region, ts, step, forecast, history): the next steps of each region's series counts (region, ts, y), by Holt-Winters on its last 4 * history steps.

    Rows of a region and time are summed; null regions, times and values are left out, and so are regions of less than three times. The next times
    follow at the distance of the last two."""
    summed = counts.where("region IS NOT NULL AND ts IS NOT NULL AND y IS NOT NULL").groupBy("region", "ts").agg(F.sum(F.col("y").cast("double")).alias("y"))
    late = summed.withColumn("_back", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("ts"))))
    late = late.where(F.col("_back") <= 4 * history) if history else late
    rows = late.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("ts", "y"))).alias("s")).where(F.size("s") >= 3)  # of a bounded history
    seconds = lambda n: F.unix_micros(F.element_at("s", n)["ts"].cast("timestamp"))
    made = rows.select("region", F.size("s").alias("history"), seconds(-1).alias("last"), (seconds(-1) - seconds(-2)).alias("apart"), F.posexplode(holt_winters(F.col("s.y"), season, horizon)).alias("at", "forecast"))
    return made.select("region", F.timestamp_micros(F.col("last") + F.col("apart") * (F.col("at") + 1)).cast("timestamp_ntz").alias("ts"), (F.col("at") + 1).alias("step"), "forecast", "history")


def kmeans(rows: DataFrame, k: int = 4, seed: int = 42, steps: int = 100) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster) of rows (id, features array<double>) by Lloyd's steps, and the centres.

    It starts from the k rows that come first by md5 of seed and id; each step sums each cluster's features on the executors, and the k centres go out with the next
    one. Of equally near centres the first counts; a centre without rows stays where it is. Ends when no centre moves, or after so many steps. With no more rows than
    clusters each is one. Rows with null features are left out; all features have as many numbers."""
    spark = rows.sparkSession
    table = cut(spark, rows.where(F.col("features").isNotNull()).select("id", "features"))
    first = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    centres = [list(r["features"]) for r in table.orderBy(first, "id").limit(k).collect()]
    if not centres:
        return table.select("id", F.lit(0).alias("cluster")), []
    width = len(centres[0])

    def nearest(centres: list[list[float]]) -> Column:
        far = [sum(((F.col("features")[i] - c[i]) * (F.col("features")[i] - c[i]) for i in range(1, width)), (F.col("features")[0] - c[0]) * (F.col("features")[0] - c[0])) for c in centres]
        distances = F.array(*far)
        return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")

    for _ in range(steps):
        sums = table.groupBy(nearest(centres).alias("cluster")).agg(F.count("*").alias("n"), *(F.sum(F.col("features")[i]).alias(f"s{i}") for i in range(width)))
        moved = list(centres)
        for r in sums.collect():  # a row for each cluster
            moved[r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(width)]
        if moved == centres:
            break
        centres = moved
    return table.select("id", nearest(centres).alias("cluster")), centres


def moments(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of rows (features array<double>, all of one width), summed on the executors."""
    if width > WIDEST:
        raise ValueError(f"rows have at most {WIDEST} features")

    def part(batches):
        import pyarrow as pa

        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = np.array(batch["features"].to_pylist(), float).reshape(-1, width)
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        values = np.concatenate([[n], total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["place", "value"])

    got = np.zeros(1 + width + width * width)
    for place, value in rows.select("features").mapInArrow(part, "place long, value double").groupBy("place").agg(F.sum("value")).collect():  # as many as the matrix has
        got[place] = value
    return int(got[0]), got[1 : 1 + width], got[1 + width :].reshape(width, width)


def components(rows: DataFrame, width: int, k: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Means (0 if not centred) and the first k principal components, a row each; the entry of a component that is greatest by amount is positive."""
    n, total, products = moments(rows, width)
    mean = total / n if centred and n else np.zeros(width)
    vectors = np.linalg.eigh(products - n * np.outer(mean, mean))[1][:, ::-1].T[:k]
    return mean, vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]


def _numbers(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _along(features: Column, mean, vector) -> Column:
    parts = F.zip_with(F.zip_with(features, _numbers(mean), lambda a, b: a - b), _numbers(vector), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def aligned(series: DataFrame) -> tuple[DataFrame, list[str]]:
    """series (unique_id, ds, y) as a row for each time (ds, features), a place for each series in order of its name, and the names.

    Rows of a series and time count by their mean. A gap is filled on the straight line, by number of times, between the values around it, and by the nearest
    value at the ends. Series without a value are left out. There are at most WIDEST series; times are as many as there are."""
    valid = series.where("unique_id IS NOT NULL AND ds IS NOT NULL AND y IS NOT NULL").groupBy("unique_id", "ds").agg(F.avg(F.col("y").cast("double")).alias("y"))
    valid = cut(series.sparkSession, valid)
    names = [r["unique_id"] for r in valid.select("unique_id").distinct().orderBy("unique_id").limit(WIDEST + 1).collect()]
    if len(names) > WIDEST:
        raise ValueError(f"at most {WIDEST} series are compared")
    grid = valid.select("ds").distinct().withColumn("unique_id", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    rows = grid.join(valid, ["unique_id", "ds"], "left")
    order = Window.partitionBy("unique_id").orderBy("ds")
    rows = rows.withColumn("_i", F.row_number().over(order))
    known = F.when(F.col("y").isNotNull(), F.struct("_i", "y"))
    rows = rows.withColumn("_a", F.last(known, ignorenulls=True).over(order)).withColumn("_b", F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    between = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * share
    value = F.coalesce(F.col("y"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between), F.col("_a.y"), F.col("_b.y"))
    wide = rows.withColumn("_v", value).groupBy("ds").agg(F.transform(F.array_sort(F.collect_list(F.struct("unique_id", "_v"))), lambda s: s["_v"]).alias("features"))
    return wide, names


def component_anomalies(series: DataFrame, k: int = 1, c: float = 5.0, least_series: int = 2, least_times: int = 10) -> DataFrame:
    """(ds, error, anomaly) for each time: the squared distance of all series' values from what k principal components of them give, and whether it lies
    more than c times the quartiles' distance above the upper quartile. No rows with fewer series or times."""
    wide, names = aligned(series)
    table = cut(series.sparkSession, wide)
    none = table.limit(0).select("ds", F.lit(0.0).alias("error"), F.lit(False).alias("anomaly"))
    if len(names) < least_series or table.count() < least_times:
        return none
    mean, vectors = components(table, len(names), k)
    off = F.zip_with("features", _numbers(mean), lambda a, b: a - b)
    error = F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)
    for vector in vectors:
        error = error - F.pow(_along(F.col("features"), mean, vector), 2)
    found = cut(series.sparkSession, table.select("ds", F.greatest(error, F.lit(0.0)).alias("error")))
    low, high = quantiles(found, "error", [0.25, 0.75])
    return found.select("ds", "error", (F.col("error") > high + c * (high - low)).alias("anomaly"))


def component_change(pixels: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(key, change): of the differences of bands, pairs of (before, after), how far each pixel goes along their first principal component, as a share of the farthest.

    Differences aren't centred. A pixel with a null band has no row; where nothing changed all are 0."""
    table = pixels.select(key, F.array(*((F.col(a) - F.col(b)).cast("double") for a, b in pairs)).alias("features")).where(F.forall("features", lambda x: x.isNotNull()))
    table = cut(pixels.sparkSession, table)
    mean, vectors = components(table, len(pairs), 1, centred=False)
    rows = table.select(key, F.abs(_along(F.col("features"), mean, vectors[0])).alias("change"))
    most = rows.agg(F.max("change")).first()[0]
    return rows.select(key, (F.col("change") / (most or 1.0)).alias("change"))

"""Map algebra on pixels, a row each: spectral indices, change, transitions, temperatures, weighted risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

#: Thermal constants of the sensor's band (K1, K2), emissivity, wavelength over h * c / k in 1 / K.
K1, K2, EMISSIVITY, PER_KELVIN = 774.8853, 1321.0789, 0.97, 10.895e-6 / 1.438e-2


def clipped(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) within -1 and 1; null where both are 0."""
    total = (a + b).cast("double")
    return F.when(total != 0, clipped((a - b) / total))


def enhanced_vegetation(nir: Column, red: Column, blue: Column) -> Column:
    below = nir + 6.0 * red - 7.5 * blue + 1.0
    return F.when(below != 0, clipped(2.5 * (nir - red) / below))


def surface_kelvin(radiance: Column) -> Column:
    """Brightness temperature of a radiance, corrected for emissivity; null where there is no radiance."""
    bright = K2 / F.log(K1 / radiance + 1)
    return F.when(radiance > 0, bright / (1 + PER_KELVIN * bright * F.log(F.lit(EMISSIVITY))))


def change_magnitude(pixels: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Adds magnitude, the length of the change over the pairs of bands, as a share of the longest."""
    length = F.sqrt(sum((F.pow(F.col(b).cast("double") - F.col(a), F.lit(2)) for a, b in pairs), F.lit(0.0)))
    most = pixels.agg(F.max(length)).first()[0]
    return pixels.withColumn("magnitude", length / most if most else F.lit(None).cast("double"))


def transitions(pixels: DataFrame, before: str, after: str) -> DataFrame:
    """How many pixels went from each class to each, and their share of those that started there."""
    counted = pixels.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("before").agg(F.sum("n").alias("total"))
    return counted.join(totals, "before").select("before", "after", "n", (F.col("n") / F.col("total")).alias("share"))


def directions(pixels: DataFrame, x: str, y: str) -> DataFrame:
    """Pixels in eight directions from their centre, counted from east against the clock."""
    centre = pixels.agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))  # one row
    turn = F.pmod(F.degrees(F.atan2(F.col(y) - F.col("cy"), F.col(x) - F.col("cx"))) + 360.0, F.lit(360.0))
    return pixels.join(F.broadcast(centre)).groupBy(F.pmod(F.floor(turn / 45.0), F.lit(8)).cast("int").alias("direction")).agg(F.count("*").alias("n"))


def weighted_risk(pixels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds risk: the weighted sum of the columns, each scaled to 0..1 by its least and largest value (0 where they are equal)."""
    bounds = pixels.agg(*(f(c).cast("double") for c in weights for f in (F.min, F.max))).first()  # one row
    scaled = F.lit(0.0)
    for i, (c, w) in enumerate(weights.items()):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        scaled = scaled + (w * F.coalesce((F.col(c) - low) / (high - low), F.lit(0.0)) if low is not None and high > low else F.lit(0.0))
    return pixels.withColumn("risk", scaled)


def levels(pixels: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Adds level, the number of the shares' percentiles of value that it reaches; null without a value."""
    cuts = ranks.quantiles(pixels, value, shares)
    return pixels.withColumn("level", sum(((F.col(value) >= F.lit(c).cast("double")).cast("int") for c in cuts), F.lit(0)))


def z_anomalies(pixels: DataFrame, values: list[str], sigma: float = 2.0, references: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds anomaly: whether a pixel lies more than sigma deviations from the mean, by all values' mean distance if there are several. references gives (mean, deviation) of earlier images, else the image's own count; a deviation of 0 is 1.

    Pixels without any of the values are no anomalies; those without some go by the others."""
    own = pixels.agg(*(f(c).cast("double") for c in values for f in (F.avg, F.stddev_pop))).first()  # one row
    parts = []
    for i, c in enumerate(values):
        mean, deviation = (references or {}).get(c, (own[2 * i], own[2 * i + 1]))
        parts.append(F.abs((F.col(c) - F.lit(mean)) / F.lit(deviation or 1.0)))
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    return pixels.withColumn("anomaly", F.when(F.size(known) > 0, mean > sigma).otherwise(False))

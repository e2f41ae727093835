"""Neighbourhoods of pixels, a row each: patches of a mask, landscape measures, opening and closing, local statistics.

Coordinates are whole numbers from 0 to 2^31 - 2. A pixel's number holds both, so neighbours are found by an equality join on it, and no row of pixels or tile is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .graph import connected_components

ROW = 2**31


def _cells(mask: DataFrame, x: str, y: str) -> DataFrame:
    """Different pixels (node, x, y); those without a coordinate go."""
    cells = mask.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).dropna().distinct()
    return cells.select((F.col("y") * ROW + F.col("x")).alias("node"), "x", "y")


def patches(mask: DataFrame, x: str, y: str) -> DataFrame:
    """The mask's pixels (x, y) with the least pixel number of their patch; pixels that share a side are in one patch. Repeated pixels count once, no rows give none."""
    spark = mask.sparkSession
    cells = cut(spark, _cells(mask, x, y))
    ahead = cells.select("node", F.explode(F.array(F.col("node") + 1, F.col("node") + ROW)).alias("next"))
    links = ahead.join(cells.select(F.col("node").alias("next")), "next").select("node", "next")
    alone = cells.select("node", F.col("node").alias("next"))
    return cells.join(connected_components(spark, links.union(alone), "node", "next"), "node").select("x", "y", F.col("component").alias("patch"))


def outlines(patched: DataFrame, least: int = 1) -> DataFrame:
    """Pixels, bounds and centre of each patch of at least so many pixels."""
    bounds = (f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max)))
    found = patched.groupBy("patch").agg(F.count("*").alias("n_pixels"), *bounds, F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y"))
    return found.where(F.col("n_pixels") >= least)


def landscape(sizes: DataFrame, total: int, pixel_m2: float, large_m2: float) -> DataFrame:
    """Coverage in percent, area, patches, their mean size, the largest one's share and how many are large, from patches' n_pixels; all 0 without patches."""
    area = F.coalesce(F.sum("n_pixels"), F.lit(0)) * pixel_m2
    return sizes.agg(
        F.coalesce(F.sum("n_pixels") * 100.0 / F.lit(total or None), F.lit(0.0)).alias("coverage"),
        area.alias("area_m2"),
        F.count("*").alias("n_patches"),
        F.coalesce(F.avg("n_pixels") * pixel_m2, F.lit(0.0)).alias("mean_m2"),
        F.coalesce(F.max("n_pixels") / F.sum("n_pixels"), F.lit(0.0)).alias("largest_share"),
        F.count_if(F.col("n_pixels") * pixel_m2 >= large_m2).alias("n_large"),
    )


def _spread(cells: DataFrame, reach: int, cross: bool) -> DataFrame:
    """Each pixel at its own place and at all places around it, with the steps in between."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if not cross or abs(i) + abs(j) <= reach]
    at = F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in steps))).alias("at")
    return cells.select(at, *(c for c in cells.columns if c not in ("x", "y"))).select("at.*", *(c for c in cells.columns if c not in ("x", "y")))


def dilated(mask: DataFrame, width: int, height: int, times: int) -> DataFrame:
    """Pixels (x, y) of the raster at most so many steps along sides from the mask. One grouping, whatever the number of steps."""
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return _spread(mask.select("x", "y"), times, True).where(inside).distinct()


def eroded(mask: DataFrame, times: int) -> DataFrame:
    """Pixels of the mask all of whose neighbours within so many steps are in it; what lies outside the raster is not."""
    need = 2 * times * (times + 1) + 1
    return _spread(mask.select("x", "y").distinct(), times, True).groupBy("x", "y").agg(F.count("*").alias("_n")).where(F.col("_n") == need).select("x", "y")


def opened(mask: DataFrame, width: int, height: int, times: int) -> DataFrame:
    """Erosion, then dilation: specks go."""
    return dilated(eroded(mask, times), width, height, times)


def closed(mask: DataFrame, width: int, height: int, times: int) -> DataFrame:
    """Dilation, then erosion: holes are filled."""
    return eroded(dilated(mask, width, height, times), times)


def local_statistics(pixels: DataFrame, x: str, y: str, value: str, reach: int) -> DataFrame:
    """Mean and population deviation of the values within reach pixels of each pixel (x, y, value, mean, deviation), over those that lie in the raster.

    Partial sums meet before the shuffle, and a place gets at most (2 reach + 1)^2 values; a null value counts nowhere, repeated pixels count as often as they stand there."""
    own = pixels.where(F.col(value).isNotNull()).select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.col(value).cast("double").alias("value"))
    place = [F.col("x").alias("_x"), F.col("y").alias("_y")]
    spread = _spread(own.select("x", "y", *place, "value"), reach, False)
    middle = F.max(F.when((F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), F.col("value")))
    return spread.groupBy("x", "y").agg(middle.alias("value"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")).where(F.col("value").isNotNull())


def bare_soil(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    """((swir + red) - (nir + blue)) over their sum, within -1 and 1; null where the sum is 0."""
    total = (swir + red + nir + blue).cast("double")
    return F.when(total != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ((swir + red) - (nir + blue)) / total)))


#: Fixed values of the water indices: coefficients of chlorophyll's polynomial, of suspended matter (Ap, Cp, Bp) and of turbidity in clear and turbid water.
CHLOROPHYLL = (0.283, -2.753, 1.457, 0.659, -1.403)
AP, CP, BP = 355.85, 1.74, 0.19563
CLEAR, TURBID = 228.1, 3078.9
#: What counts for the proxy of oxygen demand.
OXYGEN = {"red over blue": 0.5, "red over green": 0.3, "ndwi drop": 0.2}


def chlorophyll(blue: Column, green: Column, red: Column) -> Column:
    """Chlorophyll-a from reflectances: ten to a polynomial of the logarithm of the larger of blue and green over red."""
    ratio = F.log10(F.greatest(F.greatest(blue, green) / (red + 1e-6), F.lit(1e-6)))
    return F.pow(F.lit(10.0), sum((c * F.pow(ratio, F.lit(float(i))) for i, c in enumerate(CHLOROPHYLL)), F.lit(0.0)))


def _low(red: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.3), red))


def suspended_matter(red: Column) -> Column:
    return AP * _low(red) / (1 - _low(red) / CP + 1e-6) + BP


def turbidity(red: Column) -> Column:
    return F.when(_low(red) < 0.05, CLEAR * _low(red)).otherwise(TURBID * _low(red) / (1 - _low(red) + 1e-6))


def oxygen_demand(blue: Column, green: Column, red: Column, ndwi: Column) -> Column:
    """The proxy of biological oxygen demand: red over blue and over green, each up to 3, and how far the water index is below 0, up to 1."""
    within = lambda c, most: F.greatest(F.lit(0.0), F.least(F.lit(most), c))
    parts = {"red over blue": within(red / (blue + 1e-6), 3.0), "red over green": within(red / (green + 1e-6), 3.0), "ndwi drop": within(-ndwi, 1.0)}
    return sum((w * parts[n] for n, w in OXYGEN.items()), F.lit(0.0))


def expansion(areas: DataFrame, key: str, year: str, area: str, high: float = 1.92, medium: float = 0.59) -> DataFrame:
    """Growth in percent a year from each year of a key to its next one (intensity), with a level: fast, medium, slow or none."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(year)
    steps = areas.select(key, F.lag(year).over(w).alias("from_year"), F.col(year).alias("to_year"), F.lag(area).over(w).alias("_a"), F.col(area).alias("_b")).where("from_year is not null")
    rate = (F.col("_b") - F.col("_a")) / F.greatest(F.col("_a"), F.lit(1e-6)) / F.greatest(F.col("to_year") - F.col("from_year"), F.lit(1)) * 100.0
    level = F.when(F.col("intensity") > high, "fast").when(F.col("intensity") > medium, "medium").when(F.col("intensity") > 0, "slow").otherwise("none")
    return steps.withColumn("intensity", rate).select(key, "from_year", "to_year", (F.col("_b") - F.col("_a")).alias("gained"), "intensity", level.alias("level"))

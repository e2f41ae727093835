"""Who is near whom, by cells of a grid: whether any two of a group are, and the nearest of other points.

No task sees all pairs of a group. Two in one small cell are near by its size alone, so only cells with one in them are compared with the
cells around; the nearest point is found by going down a pyramid of occupied cells, where those that can't hold it are dropped."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, forget


def any_near(objects: DataFrame, keys: list[str], x: str, y: str, most: float) -> DataFrame:
    """(keys, n, near) of each group of objects: how many have a place, and whether two of them are at most so far apart. most is above 0."""
    side = most / 2  # the diagonal is shorter than most
    cell = lambda c: F.floor(F.col(c) / side)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    groups = [f"_k{i}" for i in range(len(keys))]
    placed = objects.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*named, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), cell(x).alias("_i"), cell(y).alias("_j"))
    cells = cut(objects.sparkSession, placed.groupBy(*groups, "_i", "_j").agg(F.count("*").alias("_n"), F.first("_x").alias("_x"), F.first("_y").alias("_y")))
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if i or j > 0]
    around = F.explode(F.array(*(F.struct((F.col("_i") + i).alias("_i"), (F.col("_j") + j).alias("_j")) for i, j in ahead))).alias("to")
    one = cells.select(*groups, F.col("_x").alias("_ax"), F.col("_y").alias("_ay"), around).select(*groups, "_ax", "_ay", "to.*")
    safe = lambda d: d.select(*(F.struct(F.col(g)).alias(g) for g in groups), *(c for c in d.columns if c not in groups))  # nulls are a group like others
    met = safe(one).join(safe(cells), [*groups, "_i", "_j"]).where(F.hypot(F.col("_ax") - F.col("_x"), F.col("_ay") - F.col("_y")) <= most)
    close = met.select(*groups).distinct().withColumn("_met", F.lit(True))
    total = safe(cells).groupBy(*groups).agg(F.sum("_n").alias("n"), F.max("_n").alias("_most"))
    return total.join(close, groups, "left").select(*(F.col(g)[g].alias(k) for g, k in zip(groups, keys)), "n", ((F.col("_most") > 1) | F.coalesce("_met", F.lit(False))).alias("near"))


def _bounds(level: int, side: float) -> tuple[Column, Column]:
    """Least and most distance from a point (px, py) to anything in the cell (i, j) of a level."""
    size = side * 2**level
    low = lambda p, c: F.greatest(F.lit(0.0), F.col(c) * size - F.col(p), F.col(p) - (F.col(c) + 1) * size)
    high = lambda p, c: F.greatest(F.abs(F.col(p) - F.col(c) * size), F.abs((F.col(c) + 1) * size - F.col(p)))
    return F.hypot(low("px", "i"), low("py", "j")), F.hypot(high("px", "i"), high("py", "j"))


def nearest(points: DataFrame, targets: DataFrame, side: float = 1.0) -> DataFrame:
    """(id, distance) of each of points (id, x, y): how far the nearest of targets (x, y) is; null without targets. Points without a place have no row.

    side: of the smallest cells, about the distance of neighbouring targets. Each level of the pyramid is a join of the cells that a point may
    find its nearest in with the occupied ones below; few stay, however dense targets are."""
    spark = points.sparkSession
    there = targets.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    there = cut(spark, there.select("x", "y", F.floor(F.col("x") / side).alias("i"), F.floor(F.col("y") / side).alias("j")))
    asked = points.where("x IS NOT NULL AND y IS NOT NULL").select("id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    asked = cut(spark, asked.withColumn("row", F.monotonically_increasing_id()))
    a, b, c, d = there.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    if a is None:
        return asked.select("id", F.lit(None).cast("double").alias("distance"))
    top = max(1, max(b - a, d - c) + 1).bit_length()
    cells = [cut(spark, there.select("i", "j").distinct())]
    for _ in range(top):
        up = lambda n: F.floor(F.col(n) / 2).alias(n)
        cells.append(cut(spark, cells[-1].select(up("i"), up("j")).distinct()))
    roots = F.broadcast(cells[top])  # four cells at most, as they are larger than all that there is
    held = cut(spark, asked.crossJoin(roots))
    for level in range(top - 1, -1, -1):
        children = F.explode(F.array(*(F.struct((2 * F.col("i") + i).alias("i"), (2 * F.col("j") + j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("c")
        low, high = _bounds(level, side)
        found = held.select("row", "id", "px", "py", children).select("row", "id", "px", "py", "c.*").join(cells[level], ["i", "j"])
        found = found.withColumns({"low": low, "reach": F.min(high).over(Window.partitionBy("row"))}).where(F.col("low") <= F.col("reach") * (1 + 1e-12))
        now = cut(spark, found.select("row", "id", "px", "py", "i", "j"))
        forget(held)
        held = now
    best = held.join(there, ["i", "j"]).groupBy("row", "id").agg(F.min(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))).alias("distance"))
    out = cut(spark, best.select("id", "distance"))
    forget(held, *cells, there, asked)
    return out


def growth_patterns(patched: DataFrame, old: DataFrame, width: int, height: int, pixel_m: float, infill: float = 0.6, leapfrog_m: float = 500.0) -> DataFrame:
    """(patch, n_pixels, old_share, distance_m, pattern) of patches of new ground (x, y, patch) by the old ground (x, y) of a raster from (0, 0).

    old_share: of the pixels at the patch's sides, inside the raster, how many are old. distance_m: from the pixel of the patch's centre to the nearest old one, null without any.
    infilling from a share of infill on, else leapfrog from a distance on (and without old ground), else edge-expansion."""
    sides = F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))))).alias("s")
    border = patched.select("patch", sides).select("patch", "s.*").distinct().where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).join(patched.select("patch", "x", "y"), ["patch", "x", "y"], "left_anti")
    marked = border.join(old.select("x", "y", F.lit(1).alias("_old")).distinct(), ["x", "y"], "left").groupBy("patch").agg(F.count("*").alias("_n"), F.count("_old").alias("_o"))
    sizes = patched.groupBy("patch").agg(F.count("*").alias("n_pixels"), F.floor(F.avg("x")).alias("x"), F.floor(F.avg("y")).alias("y"))
    far = nearest(sizes.select(F.col("patch").alias("id"), "x", "y"), old).select(F.col("id").alias("patch"), (F.col("distance") * pixel_m).alias("distance_m"))
    rows = sizes.join(marked, "patch", "left").join(far, "patch", "left")
    share = F.coalesce("_o", F.lit(0)) / F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))
    pattern = F.when(share >= infill, "infilling").when(F.coalesce("distance_m", F.lit(math.inf)) >= leapfrog_m, "leapfrog").otherwise("edge-expansion")
    return rows.select("patch", "n_pixels", share.alias("old_share"), "distance_m", pattern.alias("pattern"))


def shelter_gaps(risky: DataFrame, shelters: DataFrame, coverage_m: float, pixel_m: float, least: int = 20) -> DataFrame:
    """Outlines of the patches of at least so many pixels of risky (x, y) that no shelter (x, y) is within coverage of."""
    from .patches import outlines, patches

    pixels = risky.select("x", "y").distinct()
    far = nearest(pixels.select(F.struct("x", "y").alias("id"), "x", "y"), shelters)
    gap = far.where(F.col("distance").isNull() | (F.col("distance") * pixel_m > coverage_m)).select("id.x", "id.y")
    return outlines(patches(gap, "x", "y"), least)

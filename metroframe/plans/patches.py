"""Queries over neighbourhoods of pixels (made from parts) and over boxes in regions (made from events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patches, raster, regions
from ..sources.tables import load
from .registry import registry
from .scenes import PIXELS, SEEN, pixels, seen

QUERIES, ORACLE_SQL, query = registry()
SIDE = 2**31
MASK = f"m AS MATERIALIZED (SELECT x, y, y * {SIDE} + x AS id FROM ({PIXELS}) WHERE land >= 2)"
PATCHES = f"""{MASK}, l AS MATERIALIZED (SELECT id AS a, id + o AS b FROM m, (VALUES (1), (-1), ({SIDE}), (-{SIDE})) t(o) WHERE id + o IN (SELECT id FROM m)), r(a, b) AS (SELECT id, id FROM m UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    p AS (SELECT x, y, patch FROM m JOIN (SELECT a AS id, min(b) AS patch FROM r GROUP BY 1) USING (id)), o AS (SELECT patch, count(*) AS n_pixels, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, avg(x) AS centre_x, avg(y) AS centre_y FROM p GROUP BY 1)"""


def _patched(spark, folder):
    return patches.patches(pixels(spark, folder).where("land >= 2"), "x", "y")


@query(f"WITH RECURSIVE {PATCHES} SELECT patch, n_pixels, min_x, max_x, min_y, max_y, round(centre_x, 6) AS centre_x, round(centre_y, 6) AS centre_y FROM o WHERE n_pixels >= 3")
def image_patches(spark, folder):
    return patches.outlines(_patched(spark, folder), 3).withColumn("centre_x", F.round("centre_x", 6)).withColumn("centre_y", F.round("centre_y", 6))


@query(f"""WITH RECURSIVE {PATCHES} SELECT round(sum(n_pixels) * 100.0::DOUBLE / (SELECT count(*) FROM ({PIXELS})), 6) AS coverage, (sum(n_pixels) * 100)::DOUBLE AS area_m2, count(*) AS n_patches, round(avg(n_pixels) * 100, 6) AS mean_m2,
    round(max(n_pixels) / sum(n_pixels)::DOUBLE, 6) AS largest_share, count(*) FILTER (n_pixels >= 10) AS n_large FROM o""")
def landscape_metrics(spark, folder):
    sizes = patches.outlines(_patched(spark, folder))
    found = patches.landscape(sizes, pixels(spark, folder).count(), 100.0, 1000.0)
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


_STEPS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(i, j)"
_HEIGHT = "(SELECT max(y) FROM a)"


def _grow(name, of):
    return f"{name} AS (SELECT DISTINCT x + i AS x, y + j AS y FROM {of}, {_STEPS} WHERE x + i BETWEEN 0 AND 49 AND y + j BETWEEN 0 AND {_HEIGHT})"


def _shrink(name, of):
    return f"{name} AS (SELECT x, y FROM {of} WHERE " + " AND ".join(f"(x + {i}, y + {j}) IN (SELECT (x, y) FROM {of})" for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))) + ")"


@query(f"WITH a AS ({PIXELS}), b AS MATERIALIZED (SELECT x, y FROM a WHERE nir > 40), {_shrink('c', 'b')}, {_grow('d', 'c')}, {_grow('f', 'd')}, {_shrink('g', 'f')} SELECT x, y FROM g")
def cleaned_mask(spark, folder):
    """Specks out, holes filled, one step each."""
    rows = pixels(spark, folder)
    height = (rows.agg(F.max("y")).first()[0] or 0) + 1
    return patches.closed(patches.opened(rows.where("nir > 40"), 50, height, 1), 50, height, 1)


@query(f"WITH a AS ({PIXELS}) SELECT c.x, c.y, c.red::DOUBLE AS value, round(avg(n.red), 6) AS mean, round(stddev_pop(n.red), 6) AS deviation FROM a c JOIN a n ON n.x BETWEEN c.x - 2 AND c.x + 2 AND n.y BETWEEN c.y - 2 AND c.y + 2 GROUP BY ALL")
def local_statistics(spark, folder):
    found = patches.local_statistics(pixels(spark, folder), "x", "y", "red", 2)
    return found.select("x", "y", "value", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


_R, _G, _B = (f"({c} / 250.0::DOUBLE)" for c in ("red", "green", "blue"))
_LOW = f"greatest(0.0::DOUBLE, least(0.3::DOUBLE, {_R}))"
_RATIO = f"log10(greatest(greatest({_B}, {_G}) / ({_R} + 1e-6::DOUBLE), 1e-6::DOUBLE))"


@query(f"""SELECT p_partkey, round(10::DOUBLE ** ({' + '.join(f'{c}::DOUBLE * {_RATIO} ** {i}' for i, c in enumerate(patches.CHLOROPHYLL))}), 5) AS chlorophyll, round({patches.AP}::DOUBLE * {_LOW} / (1 - {_LOW} / {patches.CP}::DOUBLE + 1e-6::DOUBLE) + {patches.BP}::DOUBLE, 5) AS suspended,
    round(CASE WHEN {_LOW} < 0.05::DOUBLE THEN {patches.CLEAR}::DOUBLE * {_LOW} ELSE {patches.TURBID}::DOUBLE * {_LOW} / (1 - {_LOW} + 1e-6::DOUBLE) END, 5) AS turbidity,
    round(0.5::DOUBLE * least(3, red / 250.0::DOUBLE / (blue / 250.0::DOUBLE + 1e-6::DOUBLE)) + 0.3::DOUBLE * least(3, red / 250.0::DOUBLE / (green / 250.0::DOUBLE + 1e-6::DOUBLE)) + 0.2::DOUBLE * greatest(0, least(1, (nir - green) / (green + nir)::DOUBLE)), 5) AS oxygen FROM ({PIXELS})""")
def water_quality(spark, folder):
    r, g, b = (F.col(c) / 250.0 for c in ("red", "green", "blue"))
    found = {"chlorophyll": patches.chlorophyll(b, g, r), "suspended": patches.suspended_matter(r), "turbidity": patches.turbidity(r), "oxygen": patches.oxygen_demand(b, g, r, raster.normalised_difference(F.col("green"), F.col("nir")))}
    return pixels(spark, folder).select("p_partkey", *(F.round(v, 5).alias(n) for n, v in found.items()))


@query(f"SELECT p_partkey, round((later + red - nir - blue) / (later + red + nir + blue)::DOUBLE, 6) AS bare, (blue - nir) / (blue + nir)::DOUBLE > 0.1::DOUBLE AS built FROM ({PIXELS})")
def ground_indices(spark, folder):
    built = raster.normalised_difference(F.col("blue"), F.col("nir")) > 0.1
    bare = patches.bare_soil(F.col("blue"), F.col("red"), F.col("nir"), F.col("later"))
    return pixels(spark, folder).select("p_partkey", F.round(bare, 6).alias("bare"), built.alias("built"))


@query("""WITH a AS (SELECT o_orderpriority AS place, year(o_orderdate)::INT AS y, count(*) AS a FROM orders GROUP BY 1, 2), b AS (SELECT place, lag(y) OVER w AS from_year, y AS to_year, lag(a) OVER w AS a, a AS b FROM a WINDOW w AS (PARTITION BY place ORDER BY y)),
    i AS (SELECT place, from_year, to_year, b - a AS gained, round((b - a) / greatest(a, 1e-6::DOUBLE) / greatest(to_year - from_year, 1) * 100, 6) AS intensity FROM b WHERE from_year IS NOT NULL)
    SELECT *, CASE WHEN intensity > 1.92 THEN 'fast' WHEN intensity > 0.59 THEN 'medium' WHEN intensity > 0 THEN 'slow' ELSE 'none' END AS level FROM i""")
def expansion_levels(spark, folder):
    areas = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("place"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("area"))
    return patches.expansion(areas, "place", "year", "area").withColumn("intensity", F.round("intensity", 6))


RINGS = [(1, "lane", [(10.0, 10.0), (80.0, 15.0), (60.0, 90.0)]), (2, "walk", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]), (3, "lane", [(20.0, 30.0), (90.0, 30.0), (70.0, 60.0), (90.0, 90.0), (20.0, 90.0)])]
BOX = "[(event_id * 37 % 90)::DOUBLE, (event_id * 53 % 90)::DOUBLE, (event_id * 37 % 90 + 12)::DOUBLE, (event_id * 53 % 90 + 9)::DOUBLE]"
_CAMERAS = "(SELECT list(DISTINCT camera ORDER BY camera) AS c FROM s)"


def _rings_sql():
    """Each region's corners with the ones before, a row per side; regions belong to the first three cameras by name."""
    sides = [f"({i + 1}, {region}, '{kind}', {a[0]}::DOUBLE, {a[1]}::DOUBLE, {ring[j - 1][0]}::DOUBLE, {ring[j - 1][1]}::DOUBLE)" for i, (region, kind, ring) in enumerate(RINGS) for j, a in enumerate(ring)]
    return f"g AS (SELECT c[n] AS camera, region, kind, ax, ay, bx, py FROM (VALUES {', '.join(sides)}) v(n, region, kind, ax, ay, bx, py), {_CAMERAS})"


def _objects(spark, folder):
    at = lambda k, more: (F.col("event_id") * k % 90 + more).cast("double")
    return seen(spark, folder).withColumn("box", F.array(at(37, 0), at(53, 0), at(37, 12), at(53, 9)))


def _regions(spark, rows):
    cameras = [r[0] for r in rows.select("camera").distinct().orderBy("camera").limit(len(RINGS)).collect()]
    made = [(c, region, kind, [list(p) for p in ring]) for c, (region, kind, ring) in zip(cameras, RINGS)]
    return spark.createDataFrame(made, "camera string, region long, kind string, ring array<array<double>>")


INSIDE = f"""s AS (SELECT *, {BOX} AS box FROM ({SEEN})), {_rings_sql()},
    i AS (SELECT event_id, s.camera, label, confidence, value, region, kind, count(*) FILTER ((ay > box[4]) != (py > box[4]) AND (box[1] + box[3]) / 2 < (bx - ax) * (box[4] - ay) / CASE WHEN py = ay THEN 1e-9 ELSE py - ay END + ax) % 2 = 1 AS matched FROM s JOIN g ON g.camera = s.camera GROUP BY ALL)"""


@query(f"WITH {INSIDE} SELECT event_id, region, matched::INT::DOUBLE AS overlap_ratio, matched FROM i")
def objects_in_regions(spark, folder):
    rows = _objects(spark, folder)
    return regions.matched(rows, _regions(spark, rows), ["camera"], "box", "foot").select("event_id", "region", "overlap_ratio", "matched")


@query(f"""WITH s AS (SELECT *, {BOX} AS box FROM ({SEEN})), {_rings_sql()}, b AS (SELECT camera, region, min(ax) AS x, max(ax) AS xx, min(ay) AS y, max(ay) AS yy FROM g GROUP BY 1, 2)
    SELECT event_id, region, round(greatest(0, least(xx, box[3]) - greatest(x, box[1])) * greatest(0, least(yy, box[4]) - greatest(y, box[2])) / 108::DOUBLE, 4) AS overlap_ratio FROM s JOIN b USING (camera) WHERE overlap_ratio > 0""")
def overlapped_regions(spark, folder):
    rows = _objects(spark, folder)
    return regions.matched(rows, _regions(spark, rows), ["camera"], "box", "overlap").where("matched").select("event_id", "region", "overlap_ratio")


@query(f"WITH {INSIDE} SELECT event_id, label, region, round(least(value / 100::DOUBLE, confidence), 4) AS confidence FROM i WHERE matched AND label IN ('car', 'bike') AND kind != 'walk' AND round(least(value / 100::DOUBLE, confidence), 4) >= 0.2")
def occupied_regions(spark, folder):
    rows = _objects(spark, folder).withColumn("track_confidence", F.col("value") / 100.0)
    found = regions.matched(rows, _regions(spark, rows), ["camera"], "box", "foot")
    return regions.occupancy(found, "label", "kind", ["car", "bike"], ["walk"], 0.0, 0.2).select("event_id", "label", "region", "confidence")

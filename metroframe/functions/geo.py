"""Distances and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mean radius of the earth and the alphabet of geohashes.
RADIUS_KM = 6371.0088
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null where a coordinate is."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(half))


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash cell of a point; a point on a border belongs to the upper cell. Integer arithmetic only, so it stays in generated code."""
    bits = {0: (5 * precision + 1) // 2, 1: 5 * precision // 2}
    place = {
        0: F.least(F.floor((lon + 180) / 360 * 2 ** bits[0]), F.lit(2 ** bits[0] - 1)),
        1: F.least(F.floor((lat + 90) / 180 * 2 ** bits[1]), F.lit(2 ** bits[1] - 1)),
    }
    letters = []
    for first in range(0, 5 * precision, 5):
        code = F.lit(0)
        for i in range(first, first + 5):
            axis = i % 2
            code = code * 2 + F.shiftright(place[axis], bits[axis] - 1 - i // 2).bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit(BASE32), (code + 1).cast("int"), 1))
    return F.concat(*letters)


def geohash_centre(cell: Column, precision: int) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a cell of so many letters."""
    codes = [F.position(F.substring(cell, i + 1, 1), F.lit(BASE32)) - 1 for i in range(precision)]
    place, size = [F.lit(0).cast("long"), F.lit(0).cast("long")], [0, 0]
    for i in range(5 * precision):
        bit = F.shiftright(codes[i // 5], 4 - i % 5).bitwiseAND(F.lit(1))
        place[i % 2] = place[i % 2] * 2 + bit
        size[i % 2] += 1
    return (place[1] + 0.5) / 2 ** size[1] * 180 - 90, (place[0] + 0.5) / 2 ** size[0] * 360 - 180


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (least lon, least lat, greatest lon, greatest lat), borders included; false without a place."""
    return F.coalesce(lat.between(box[1], box[3]) & lon.between(box[0], box[2]), F.lit(False))


def polygon_bounds(ring: Column) -> Column:
    """Least x, least y, greatest x, greatest y of an array of (x, y)."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _edges(ring: Column) -> Column:
    """Each corner with the one before it; the first with the last."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))
    return F.arrays_zip(ring.alias("a"), before.alias("b"))


def polygon_area(ring: Column) -> Column:
    """The area inside a ring of corners, whichever way round; 0 for fewer than three."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["b"][0] * e["a"][1] - e["a"][0] * e["b"][1])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(twice) / 2)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a ray to the right crosses the ring an odd number of times."""

    def crosses(e: Column) -> Column:
        (xi, yi), (xj, yj) = (e["a"][0], e["a"][1]), (e["b"][0], e["b"][1])
        at = (xj - xi) * (y - yi) / F.when(yj == yi, 1e-9).otherwise(yj - yi) + xi
        return ((yi > y) != (yj > y)) & (x < at)

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def box_overlap(a: Column, b: Column) -> Column:
    """The part of a that lies in b; 0 for an a without area."""
    both = F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return F.when(box_area(a) > 0, box_area(both) / box_area(a)).otherwise(0.0)

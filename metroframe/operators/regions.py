"""Objects in regions of a camera's picture: by their foot, their centre, or the part of their box within the region's bounds; occupancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import box_overlap, in_polygon, polygon_bounds


def matched(objects: DataFrame, regions: DataFrame, keys: list[str], box: str, strategy: str) -> DataFrame:
    """Each object with each region (ring: array of corners) of its keys: overlap_ratio (0 to 1) and matched. Objects without a box and regions without corners match nothing.

    An equality join on the keys; regions are drawn by people, so a camera has few. Catalyst broadcasts them if their statistics allow it."""
    pairs = objects.where(F.col(box).isNotNull()).join(regions, keys)
    b, ring = F.col(box), F.col("ring")
    if strategy == "overlap":
        ratio = box_overlap(b, polygon_bounds(ring))
    elif strategy in ("foot", "centre"):
        ratio = in_polygon((b[0] + b[2]) / 2, b[3] if strategy == "foot" else (b[1] + b[3]) / 2, ring).cast("double")
    else:
        raise ValueError(f"no such strategy: {strategy}")
    rounded = pairs.withColumn("overlap_ratio", F.round(F.when(F.size(ring) > 0, ratio).otherwise(0.0), 4))
    return rounded.withColumn("matched", F.col("overlap_ratio") > 0)


def occupancy(matches: DataFrame, label: str, kind: str, labels: list[str], excluded: list[str], least_overlap: float, least_confidence: float) -> DataFrame:
    """Matches of those labels (all, if there are none) outside the excluded kinds of regions, with enough overlap; confidence is the lesser one of track and match."""
    kept = matches.where(F.col("matched") & (F.col("overlap_ratio") >= least_overlap))
    if labels:
        kept = kept.where(F.col(label).isin(*labels))
    if excluded:
        kept = kept.where(F.col(kind).isNull() | ~F.col(kind).isin(*excluded))
    sure = F.least(F.coalesce("track_confidence", F.col("confidence")), "confidence")
    return kept.withColumn("confidence", F.round(sure, 4)).where(F.col("confidence") >= least_confidence)

"""Overlap of polygon layers by exact areas and lengths; no grid takes part (``overlap`` counts cells instead).

Layers are edge tables of polygons (parts, rings, any winding). ``tile`` is the join's unit in metres and
changes cost only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns
from .arrangement import dissolve
from .geometry import ACRES_PER_M2, polygon_areas
from .offset import offset_polygons
from .planar import COORDINATES, lengths_inside, oriented, shared_areas


def overlay_areas(left: DataFrame, right: DataFrame, tile: float, left_key: str = "feature_id", right_key: str = "region_id") -> DataFrame:
    """(left_key, right_key, area_m2) of all pairs that share an area."""
    return shared_areas(oriented(left, [left_key]), oriented(right, [right_key]), tile, left_key, right_key)


def dominant_region(features: DataFrame, regions: DataFrame, tile: float, key: str = "feature_id", region: str = "region_id") -> DataFrame:
    """Region with the largest shared area per feature. Areas equal to the micrometre squared are ties; they go to
    the first region in order. Features that share no area with a region are absent."""
    shared = overlay_areas(features, regions, tile, key, region)
    return shared.groupBy(key).agg(
        F.min_by(region, F.struct(-F.round("area_m2", 6), F.col(region))).alias(region), F.max("area_m2").alias("overlap_m2")
    )


def assign_majority(
    attributes: DataFrame, features: DataFrame, regions: DataFrame, tile: float, key: str = "feature_id", region: str = "region_id",
    thresh: float | None = None,
) -> DataFrame:
    """``attributes`` with each feature's majority region and ``overlap_acres`` (left join). With ``thresh`` the overlap
    must reach that share of the region's area."""
    best = dominant_region(features, regions, tile, key, region)
    if thresh is not None:
        sizes = polygon_areas(regions, [region]).withColumnRenamed("area_m2", "_region_m2")
        best = best.join(sizes, region).where(F.col("overlap_m2") >= thresh * F.col("_region_m2"))
    return attributes.join(best.select(key, region, (F.col("overlap_m2") * ACRES_PER_M2).alias("overlap_acres")), key, "left")


def extract_by_region(
    units: DataFrame, area_of_interest: DataFrame, tile: float, key: str = "feature_id", thresh: float | None = 0.5, shrink_m: float = 2.0
) -> DataFrame:
    """(key, unit_pct) of the units of which a share of at least ``thresh`` lies in the area of interest.

    Units are shrunk by ``shrink_m`` first, so that neighbours of the area that only touch it don't count; the
    share is of the whole unit. The area of interest is a layer of polygons, which may overlap.
    """
    require_columns(area_of_interest, ["feature_id", "part", "ring", "seq", *COORDINATES], "area_of_interest")
    everything = area_of_interest.select("feature_id").distinct().withColumn("_aoi", F.lit(0))
    merged = dissolve(area_of_interest, everything, tile, "feature_id", ["_aoi"])
    shrunk = offset_polygons(units, -shrink_m, tile, [key]) if shrink_m > 0 else oriented(units, [key])
    shared = shared_areas(shrunk.select(key, *COORDINATES), merged, tile, key, "_aoi")
    sizes = polygon_areas(units, [key]).withColumnRenamed("area_m2", "_unit_m2")
    share = shared.join(sizes, key).select(key, (F.col("area_m2") / F.col("_unit_m2")).alias("unit_pct"))
    return share if thresh is None else share.where(F.col("unit_pct") >= thresh)


def min_overlap_fraction(pairs: DataFrame, left: DataFrame, right: DataFrame, tile: float, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """Shared area of given pairs divided by the smaller of the two areas, 0 when disjoint or empty.

    Layers have ``feature_id``; only features named in a pair are compared.
    """
    require_columns(pairs, [a, b], "pairs")
    wanted = pairs.select(a, b).distinct()
    la = left.withColumnRenamed("feature_id", a).join(wanted.select(a).distinct(), a, "left_semi")
    lb = right.withColumnRenamed("feature_id", b).join(wanted.select(b).distinct(), b, "left_semi")
    shared = overlay_areas(la, lb, tile, a, b)
    size_a = polygon_areas(la, [a]).withColumnRenamed("area_m2", "_ma")
    size_b = polygon_areas(lb, [b]).withColumnRenamed("area_m2", "_mb")
    smaller = F.least(F.coalesce("_ma", F.lit(0.0)), F.coalesce("_mb", F.lit(0.0)))
    share = F.coalesce("area_m2", F.lit(0.0)) / F.nullif(smaller, F.lit(0.0))
    joined = wanted.join(shared, [a, b], "left").join(size_a, a, "left").join(size_b, b, "left")
    return joined.select(a, b, F.coalesce(share, F.lit(0.0)).alias("fraction"))


def longest_zone(
    lines: DataFrame, zones: DataFrame, tile: float, key: str = "segment_id", zone: str = "zone_id"
) -> DataFrame:
    """Zone that holds the longest part of each line, with its length; ties go to the first zone in order. Lines
    outside all zones are absent."""
    inside = lengths_inside(lines, oriented(zones, [zone]), tile, key, zone)
    return inside.groupBy(key).agg(
        F.min_by(zone, F.struct(-F.round("length_m", 6), F.col(zone))).alias(zone), F.max("length_m").alias("length_m")
    )


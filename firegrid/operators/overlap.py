"""Overlap of polygon layers, measured in cells of a grid whose resolution the caller picks.

Spans of both layers are intersected as intervals per (row, column block); no pixel is exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Grid, require_columns
from .distance import line_cell_distance
from .geometry import ACRES_PER_M2
from .rasterize import blocked, join_pixels, merge_spans, polygon_spans, span_cells


def span_sizes(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"))


def shared_cells(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Number of cells shared by each intersecting pair of features of two layers."""
    a = blocked(left.select(left_key, "row", "c0", "c1"))
    b = blocked(right.select(right_key, "row", "c0", "c1")).withColumnsRenamed(
        {"c0": "d0", "c1": "d1"}
    )
    common = F.least("c1", "d1") - F.greatest("c0", "d0") + 1
    return (
        a.join(b, ["row", "_blk"])
        .where((F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1")))
        .groupBy(left_key, right_key)
        .agg(F.sum(common).alias("cells"))
    )


def dominant_region(
    features: DataFrame, regions: DataFrame, key: str = "feature_id", region: str = "region_id"
) -> DataFrame:
    """Region with the largest overlap per feature; ties go to the first region in order.
    Both inputs are span tables. Features that meet no region are absent."""
    return (
        shared_cells(features, regions, key, region)
        .groupBy(key)
        .agg(
            F.min_by(region, F.struct(-F.col("cells"), F.col(region))).alias(region),
            F.max("cells").alias("overlap_cells"),
        )
    )


def lookup_region(features: DataFrame, regions: DataFrame, key: str = "feature_id",
                  region: str = "region_id") -> DataFrame:
    """:func:`dominant_region`, raising when a feature meets no region at all."""
    out = dominant_region(features, regions, key, region)
    lost = features.select(key).distinct().join(out, key, "left_anti")
    if not lost.isEmpty():
        raise ValueError("a feature does not intersect any region")
    return out


def assign_majority(
    features: DataFrame,
    feature_spans: DataFrame,
    region_spans: DataFrame,
    grid: Grid,
    key: str = "feature_id",
    region: str = "region_id",
    thresh: float | None = None,
) -> DataFrame:
    """Left join of each feature to its majority region. With ``thresh``, the overlap must reach
    that share of the region's area. Adds the region and ``overlap_acres``."""
    best = dominant_region(feature_spans, region_spans, key, region)
    if thresh is not None:
        sizes = span_sizes(region_spans, [region]).withColumnRenamed("cells", "_region_cells")
        best = best.join(sizes, region).where(
            F.col("overlap_cells") / F.col("_region_cells") >= thresh
        )
    acres = F.col("overlap_cells") * (grid.cell * grid.cell * ACRES_PER_M2)
    return features.join(best.select(key, region, acres.alias("overlap_acres")), key, "left")


def extract_by_region(
    edges: DataFrame,
    aoi_spans: DataFrame,
    grid: Grid,
    key: str = "feature_id",
    thresh: float | None = 0.5,
    clip: bool = False,
    shrink_m: float = 2.0,
) -> DataFrame:
    """Units overlapping an area of interest after shrinking them by ``shrink_m``.

    Returns ``(key, unit_pct)`` for units whose shrunken overlap is at least ``thresh`` of their
    area, or, with ``clip``, the overlapping cells themselves.
    """
    spans = polygon_spans(edges, grid, [key])
    sizes = span_sizes(spans, [key]).withColumnRenamed("cells", "unit_cells")
    cells = span_cells(spans)
    if shrink_m > 0:
        rim = line_cell_distance(edges, grid, shrink_m, [key]).where(
            F.col("distance_m") < shrink_m
        )
        cells = cells.join(rim.select(key, "row", "col"), [key, "row", "col"], "left_anti")
    merged = merge_spans(aoi_spans.withColumn("_aoi", F.lit(1)), ["_aoi"])
    kept = join_pixels(cells, merged, "left_semi")
    share = (
        kept.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .join(sizes, key)
        .select(key, (F.col("_n") / F.col("unit_cells")).alias("unit_pct"))
    )
    if clip:
        return kept.join(share, key)
    return share if thresh is None else share.where(F.col("unit_pct") >= thresh)


def min_overlap_fraction(
    pairs: DataFrame, left: DataFrame, right: DataFrame, a: str = "a_id", b: str = "b_id"
) -> DataFrame:
    """Overlap of given pairs divided by the smaller of the two areas, 0 when disjoint or empty.

    Only the listed pairs are compared.
    """
    require_columns(pairs, [a, b], "pairs")
    la = left.withColumnRenamed("feature_id", a)
    lb = right.withColumnRenamed("feature_id", b)
    wanted = pairs.select(a, b).distinct()
    pieces_a = blocked(wanted.join(la.select(a, "row", "c0", "c1"), a))
    pieces_b = blocked(lb.select(b, "row", "c0", "c1")).withColumnsRenamed(
        {"c0": "d0", "c1": "d1"}
    )
    inter = (
        pieces_a.join(pieces_b, [b, "row", "_blk"])
        .where((F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1")))
        .groupBy(a, b)
        .agg(F.sum(F.least("c1", "d1") - F.greatest("c0", "d0") + 1).alias("_inter"))
    )
    size_a = span_sizes(la, [a]).withColumnRenamed("cells", "_ca")
    size_b = span_sizes(lb, [b]).withColumnRenamed("cells", "_cb")
    smaller = F.least(F.coalesce("_ca", F.lit(0)), F.coalesce("_cb", F.lit(0)))
    return (
        wanted.join(inter, [a, b], "left")
        .join(size_a, a, "left")
        .join(size_b, b, "left")
        .select(
            a, b,
            F.when(smaller > 0, F.coalesce("_inter", F.lit(0)) / smaller)
            .otherwise(F.lit(0.0))
            .alias("fraction"),
        )
    )


def flatten_canopy(spans: DataFrame, effect: str = "can_eff") -> DataFrame:
    """Canopy effects per cell after overlay.

    With h, m, r, k for hand, mechanical, prescribed-fire and mastication cover: Complete Hand =
    h∧r, Complete Mech = m∧r∧¬h, RxFire = r∧¬h∧¬m, Mech Thin = m∧(¬r∨h), Hand Thin = h∧¬r∧¬m,
    Masticate = k. A cell may carry several effects.
    """
    cells = span_cells(spans.select(effect, "row", "c0", "c1"))
    has = lambda name: F.bool_or(F.col(effect) == name)
    flags = cells.groupBy("row", "col").agg(
        has("Hand Thin").alias("h"), has("Mech Thin").alias("m"),
        has("RxFire").alias("r"), has("Masticate").alias("k"),
    )
    h, m, r, k = (F.col(c) for c in "hmrk")
    cases = {
        "Complete Hand": h & r,
        "Complete Mech": m & r & ~h,
        "RxFire": r & ~h & ~m,
        "Mech Thin": m & (~r | h),
        "Hand Thin": h & ~r & ~m,
        "Masticate": k,
    }
    labels = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in cases.items()]),
        lambda x: x.isNotNull(),
    )
    return flags.select("row", "col", F.explode(labels).alias(effect))


def flatten_surface(spans: DataFrame, effect: str = "surf_eff") -> DataFrame:
    """One surface effect per cell: RxFire before Manage before Rearrange."""
    order = F.create_map(
        F.lit("RxFire"), F.lit(0), F.lit("Manage"), F.lit(1), F.lit("Rearrange"), F.lit(2)
    )
    cells = span_cells(spans.select(effect, "row", "c0", "c1")).withColumn(
        "_p", F.try_element_at(order, F.col(effect))
    )
    return (
        cells.where(F.col("_p").isNotNull())
        .groupBy("row", "col")
        .agg(F.min_by(effect, "_p").alias(effect))
    )


def cell_acres(cells: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        (F.count("*") * (grid.cell * grid.cell * ACRES_PER_M2)).alias("acres"),
    )

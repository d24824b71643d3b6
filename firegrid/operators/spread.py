"""Burn-probability change of treatments, inside them and downwind of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Grid, require_columns
from .change import check_types
from .geometry import M2_PER_ACRE_SPREAD
from .rasterize import join_pixels, touched_spans
from .spatial_join import wedge_edges


def burn_probability_change(
    baseline: DataFrame, treated: DataFrame, edges: DataFrame, attrs: DataFrame, grid: Grid,
    digits: int = 4, rasters: DataFrame | None = None,
) -> DataFrame:
    """Per treatment polygon (all-touched cells, overlaps counted in each polygon): acres, mean
    and maximum of both sides, mean of the paired difference baseline − treated.

    ``baseline`` is ``(row, col, bp)``, ``treated`` is ``(type, row, col, bp)``. Both are brought
    to (polygon, cell) and combined in one aggregation, so the rasters are never joined.
    ``rasters`` lists the treated rasters' types, to spare a scan for the check.
    """
    require_columns(attrs, ["feature_id", "type"], "treatments")
    check_types(attrs, rasters if rasters is not None else treated)
    spans = touched_spans(edges, grid).join(attrs.select("feature_id", "type"), "feature_id")
    nothing = F.lit(None).cast("double")
    value = F.when(~F.isnan("bp"), F.col("bp"))
    cell = ["feature_id", "type", "row", "col"]
    bl = join_pixels(baseline, spans).select(*cell, value.alias("bl"), nothing.alias("tr"))
    tr = join_pixels(treated, spans, on=["type"]).select(
        *cell, nothing.alias("bl"), value.alias("tr")
    )
    paired = bl.unionByName(tr).groupBy(*cell).agg(F.max("bl").alias("bl"), F.max("tr").alias("tr"))
    r4 = lambda c: F.bround(c, digits)
    stats = paired.groupBy("feature_id").agg(
        F.bround(F.count("bl") * (grid.cell * grid.cell) / M2_PER_ACRE_SPREAD, 2).alias(
            "acres_gis"
        ),
        r4(F.avg("bl")).alias("bp_bl_mean"),
        r4(F.avg("tr")).alias("bp_tr_mean"),
        r4(F.avg(F.col("bl") - F.col("tr"))).alias("bp_delta_mean"),
        r4(F.max("bl")).alias("bp_bl_max"),
        r4(F.max("tr")).alias("bp_tr_max"),
    )
    return attrs.select("feature_id", "type").join(stats, "feature_id", "left").na.fill(
        0.0, ["acres_gis"]
    )


def downwind_effect(
    centers: DataFrame,
    delta_bp: DataFrame,
    grid: Grid,
    wind_direction: float | None = None,
    buffer_km: float = 10.0,
    sector_degrees: float = 45.0,
) -> DataFrame:
    """Effect on burn probability in the sector downwind of each treatment.

    ``centers`` is ``(feature_id, cx, cy[, wind_direction])``; the argument beats the column.
    Treatments without cells in their sector get NULL means and zero areas.
    """
    if wind_direction is not None:
        centers = centers.withColumn("wind_direction", F.lit(float(wind_direction)))
    elif "wind_direction" not in centers.columns:
        raise ValueError("give wind_direction or a wind_direction column")
    sector = touched_spans(
        wedge_edges(centers, buffer_km=buffer_km, sector_degrees=sector_degrees), grid
    )
    valid = delta_bp.where(F.col("delta_bp").isNotNull() & ~F.isnan("delta_bp"))
    hectares = grid.cell * grid.cell / 10000.0
    better = F.count_if(F.col("delta_bp") > 0)
    stats = (
        join_pixels(valid, sector)
        .groupBy("feature_id")
        .agg(
            F.avg("delta_bp").alias("mean_delta_bp"),
            F.max("delta_bp").alias("max_delta_bp"),
            (better * hectares).alias("area_improved_ha"),
            (better / F.count("*") * 100.0).alias("pct_area_improved"),
        )
    )
    return (
        centers.select("feature_id", F.col("wind_direction").cast("double").alias("wind_direction"))
        .join(stats, "feature_id", "left")
        .na.fill(0.0, ["area_improved_ha", "pct_area_improved"])
    )

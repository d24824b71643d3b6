"""Suppression Difficulty Index of landscapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sdi_classes as sc
from ..functions.common import half_even
from ..operators.distance import (
    CIRCLE_RADIUS_M, ROAD_BOUND_M, line_length_in_circle, road_distance, trail_density,
)
from ..operators.focal import focal_mean, slope_percent
from ..operators.rasterize import line_spans, span_cells
from ..schema import Grid, require_columns
from ..session import broadcast_if_small

ROADED_M = 100.0


def with_rtc(pixels: DataFrame, rtc: DataFrame, clipped: bool = True) -> DataFrame:
    """Add ``rtc``: resistance to control by fuel model (normally a few dozen codes).

    With ``clipped`` the code is limited to [0, highest code] and codes without an entry get 0;
    otherwise they get NULL.
    """
    table = rtc.select(F.col("code").cast("int").alias("_code"), F.col("rtc").cast("double"))
    code = F.col("fbfm40").cast("int")
    if clipped:
        top = rtc.agg(F.max("code")).first()[0]
        if top is None:
            raise ValueError("empty resistance-to-control table")
        code = F.when(code.isNotNull(), F.greatest(F.lit(0), F.least(code, F.lit(int(top)))))
    out = pixels.withColumn("_code", code).join(
        broadcast_if_small(table), "_code", "left"
    )
    if clipped:
        out = out.withColumn(
            "rtc", F.when(F.col("_code").isNotNull(), F.coalesce("rtc", F.lit(0.0)))
        )
    return out.drop("_code")


def _classes(pixels: DataFrame, slope: Column) -> DataFrame:
    """Add the classes every later formula uses several times. They stay columns of their own
    projection: inlined into each other, the class tables would outgrow a generated method."""
    return pixels.withColumn("_slope", slope).withColumns(
        {
            "_fl": sc.classify_fl("flamelength"),
            "_hua": sc.classify_hua("heatarea"),
            "_trail": sc.classify_trail_length(F.coalesce("trail_m", F.lit(0.0))),
        }
    )


def calculate_sdi(
    pixels: DataFrame, roads: DataFrame, trails: DataFrame, rtc: DataFrame, grid: Grid
) -> DataFrame:
    """Add ``sdi`` (index x 100) to landscapes with ``slpd, asp, fbfm40, flamelength, heatarea``.

    Roads and trails become two sparse cell tables that are merged first, so the pixel table is
    joined once (and not moved when the sparse side is small); everything else is one projection.
    """
    require_columns(
        pixels, ["row", "col", "slpd", "asp", "fbfm40", "flamelength", "heatarea"], "landscape"
    )
    access = road_distance(roads, grid, max_distance=ROAD_BOUND_M).join(
        trail_density(trails, grid), ["row", "col"], "full_outer"
    )
    joined = with_rtc(pixels, rtc).join(broadcast_if_small(access), ["row", "col"], "left")
    slope = F.col("_slope")
    classed = _classes(joined, sc.slope_pct_from_deg("slpd")).withColumns(
        {
            "_energy": sc.energy(F.col("_fl"), F.col("_hua")),
            "_penetr": sc.penetrability(
                sc.classify_slope_pen(slope), F.col("rtc"), sc.classify_aspect("asp"),
                F.col("_trail"),
            ),
            "_line": sc.fireline(
                F.col("rtc"), sc.slope_adjust_hand(slope), sc.slope_adjust_mach(slope)
            ),
            "_access": sc.classify_accessibility("distance_m"),
            "_hazard": F.when(F.coalesce(F.col("distance_m") <= ROADED_M, F.lit(False)), 0.0)
            .otherwise(sc.slope_hazard(slope)),
        }
    )
    base = sc.sdi_value(F.col("_energy"), F.col("_access"), F.col("_penetr"), F.col("_line"))
    value = half_even((base + F.col("_hazard")) * 100.0, 0).cast("smallint")
    return classed.select(*pixels.columns, value.alias("sdi"))


def calculate_sdi_smoothed(
    pixels: DataFrame, roads: DataFrame, trails: DataFrame, rtc: DataFrame, grid: Grid,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Smoothed variant: slope from elevation, energy and penetrability averaged over a 1-ha
    circle, true trail length in that circle (trails plus the slowest roads), base value on road
    or trail cells, truncation instead of rounding. Raster rows must be complete (nodata as
    NULL)."""
    require_columns(
        pixels, ["row", "col", "elev", "asp", "fbfm40", "flamelength", "heatarea"], "landscape"
    )
    lines = ["feature_id", "x1", "y1", "x2", "y2"]
    slow = roads.where(F.col("highway_code") > 7).select(*lines)
    all_lines = trails.select(*lines).unionByName(roads.select(*lines))
    on_line = span_cells(line_spans(all_lines.withColumn("_all", F.lit(1)), grid, ["_all"])).select(
        "row", "col", F.lit(True).alias("_on_line")
    )
    access = (
        road_distance(roads, grid, max_distance=ROAD_BOUND_M)
        .join(
            line_length_in_circle(trails.select(*lines).unionByName(slow), grid),
            ["row", "col"], "full_outer",
        )
        .join(on_line, ["row", "col"], "full_outer")
    )
    sloped = slope_percent(pixels, grid.cell, keys=keys)
    joined = with_rtc(sloped, rtc, clipped=False).join(
        broadcast_if_small(access), ["row", "col"], "left"
    )
    slope = F.col("slope_pct")
    prepared = _classes(joined, slope).withColumns(
        {
            "_energy": sc.energy(F.col("_fl"), F.col("_hua")),
            "_penetr": sc.penetrability(
                sc.classify_slope_pen(slope), F.col("rtc"), sc.classify_aspect("asp"),
                F.col("_trail"),
            ),
        }
    )
    smooth = focal_mean(prepared, ["_energy", "_penetr"], CIRCLE_RADIUS_M, grid.cell, keys)
    energy = F.when(F.col("fbfm40") > 100, F.col("_energy_focal")).when(
        F.col("fbfm40") <= 100, F.lit(1.0)
    )
    line = sc.fireline(
        F.col("rtc"), sc.slope_adjust_hand(slope, "smoothed"), sc.slope_adjust_mach(slope, "smoothed")
    )
    base = sc.sdi_value(
        energy, sc.classify_accessibility("distance_m"), F.col("_penetr_focal"), line
    )
    base = F.when(base.isNull() & (F.col("fbfm40") < 100), F.lit(0.0)).otherwise(base)
    off_line = F.when(F.col("fbfm40") == 98, F.lit(0.0)).otherwise(
        base + sc.slope_hazard(slope, "smoothed")
    )
    final = F.when(F.coalesce("_on_line", F.lit(False)), base).otherwise(off_line)
    return smooth.select(*pixels.columns, (final * 100.0).cast("int").cast("smallint").alias("sdi"))

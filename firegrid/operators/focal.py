"""Moving-window operators on pixel tables.

The raster is cut into tiles with a halo as wide as the kernel, so a pixel is shuffled once (plus
the few halo copies) instead of once per kernel cell; inside a tile the kernel is a set of window
frames along columns and then along rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256


def tiled_with_halo(
    pixels: DataFrame, halo: int, keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Copy each pixel to every tile whose halo it lies in (``_trow``, ``_tcol``, ``_own``)."""

    def reach(axis: str) -> Column:
        first = F.floor((F.col(axis) - halo) / tile).cast("int")
        last = F.floor((F.col(axis) + halo) / tile).cast("int")
        return F.explode(F.sequence(first, last))

    return (
        pixels.withColumn("_trow", reach("row"))
        .withColumn("_tcol", reach("col"))
        .withColumn(
            "_own",
            (F.floor(F.col("row") / tile) == F.col("_trow"))
            & (F.floor(F.col("col") / tile) == F.col("_tcol")),
        )
    )


def with_missing_cells(tiled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add rows for the cells that a tile lacks between its pixels (``_own`` false, no values).

    A window down a column finds a neighbour row only through a cell of that column. Tiles whose
    pixels are complete get no rows; the pixels are shuffled once, by tile.
    """
    base = [*keys, "_trow", "_tcol"]
    boxes = (
        tiled.groupBy(*base)
        .agg(
            F.count("*").alias("_n"),
            *[f(c).alias(f"_{f.__name__}_{c}") for c in ("row", "col") for f in (F.min, F.max)],
        )
        .where(
            F.col("_n")
            < (F.col("_max_row") - F.col("_min_row") + 1) * (F.col("_max_col") - F.col("_min_col") + 1)
        )
    )
    frame = (
        boxes.withColumn("row", F.explode(F.sequence("_min_row", "_max_row")))
        .withColumn("col", F.explode(F.sequence("_min_col", "_max_col")))
        .select(*base, "row", "col", F.lit(False).alias("_own"))
    )
    return tiled.unionByName(frame, allowMissingColumns=True).repartition(*base)


def disk_half_widths(radius_cells: float) -> dict[int, int]:
    """Row offset → half width of the disk ``dr² + dc² <= radius²``."""
    r = int(math.floor(radius_cells + 1e-9))
    limit = radius_cells * radius_cells + 1e-9
    return {dr: int(math.isqrt(int(limit - dr * dr))) for dr in range(-r, r + 1)}


def disk_sums(
    pixels: DataFrame,
    columns: Sequence[str],
    radius_cells: float,
    keys: Sequence[str] = (),
    tile: int = TILE,
) -> DataFrame:
    """Add ``<column>_sum`` and ``<column>_n`` (valid cells) over the disk around each pixel."""
    widths = disk_half_widths(radius_cells)
    halo = max(widths)
    base = [*keys, "_trow", "_tcol"]
    df = with_missing_cells(tiled_with_halo(pixels, halo, keys, tile), keys)
    along = Window.partitionBy(*base, "row").orderBy("col")
    parts = {}
    for w in sorted(set(widths.values())):
        frame = along.rangeBetween(-w, w)
        for c in columns:
            parts[f"_{c}_s{w}"] = F.sum(F.col(c).cast("double")).over(frame)
            parts[f"_{c}_n{w}"] = F.count(c).over(frame)
    df = df.withColumns(parts)
    down = Window.partitionBy(*base, "col").orderBy("row")

    def total(name: Callable[[int], str]) -> Column:
        terms = [
            F.coalesce(F.max(name(w)).over(down.rangeBetween(dr, dr)), F.lit(0))
            for dr, w in widths.items()
        ]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    sums = {}
    for c in columns:
        sums[f"{c}_sum"] = total(lambda w, c=c: f"_{c}_s{w}")
        sums[f"{c}_n"] = total(lambda w, c=c: f"_{c}_n{w}")
    return df.withColumns(sums).where("_own").drop("_trow", "_tcol", "_own", *parts)


def focal_mean(
    pixels: DataFrame,
    columns: Sequence[str],
    radius_m: float,
    cell: float,
    keys: Sequence[str] = (),
    tile: int = TILE,
) -> DataFrame:
    """Add ``<column>_focal``: mean over the circle, missing cells ignored."""
    out = disk_sums(pixels, columns, radius_m / cell, keys, tile)
    means = {
        f"{c}_focal": F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum") / F.col(f"{c}_n"))
        for c in columns
    }
    return out.withColumns(means).drop(*[f"{c}_{s}" for c in columns for s in ("sum", "n")])


def slope_percent(
    pixels: DataFrame, cell: float, elev: str = "elev", keys: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """Add ``slope_pct``: percent rise by Horn's 3x3 formula; missing neighbours (raster edge)
    take the centre's elevation."""
    base = [*keys, "_trow", "_tcol"]
    df = with_missing_cells(tiled_with_halo(pixels, 1, keys, tile), keys)
    along = Window.partitionBy(*base, "row").orderBy("col")
    down = Window.partitionBy(*base, "col").orderBy("row")
    z = F.col(elev).cast("double")
    at = lambda c, frame: F.max(c).over(frame)  # noqa: E731  (a one-cell frame)
    df = df.withColumns(
        {
            "_w": at(z, along.rangeBetween(-1, -1)),
            "_c": z,
            "_e": at(z, along.rangeBetween(1, 1)),
        }
    )
    near = {}
    for side, offset in (("n", -1), ("s", 1)):
        frame = down.rangeBetween(offset, offset)
        for k in ("w", "c", "e"):
            near[f"_{side}{k}"] = at(F.col(f"_{k}"), frame)
    df = df.withColumns(near)
    v = lambda c: F.coalesce(F.col(c), F.col("_c"))
    dzdx = (
        (v("_ne") + 2 * v("_e") + v("_se")) - (v("_nw") + 2 * v("_w") + v("_sw"))
    ) / (8.0 * cell)
    dzdy = (
        (v("_sw") + 2 * v("_sc") + v("_se")) - (v("_nw") + 2 * v("_nc") + v("_ne"))
    ) / (8.0 * cell)
    slope = F.when(F.col("_c").isNotNull(), F.sqrt(dzdx * dzdx + dzdy * dzdy) * 100.0)
    drop = ["_trow", "_tcol", "_own", "_w", "_c", "_e", *near]
    return df.withColumn("slope_pct", slope).where("_own").drop(*drop)

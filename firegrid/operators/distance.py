"""Distances and densities on the grid: roads, trails, line buffers."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Grid, require_columns
from ..session import checkpoint, spread
from .focal import TILE, disk_half_widths
from .rasterize import grid_edges, line_spans, span_cells

ROAD_BOUND_M = 900.0
TRAIL_RADIUS_M = 56.42
CIRCLE_RADIUS_M = 56.41896
BAND = 64


def _tile_solver(reach: int, tile: int, cell: float, limit: float, keys: list[str]):
    """Grouped function for :func:`cell_distance`: exact distances inside one tile from the
    marked cells of the tile and its margin. Self-contained, so executors need numpy and pandas
    only."""

    def solve(pdf):
        import numpy as np
        import pandas as pd

        top = int(pdf["_trow"].iloc[0]) * tile - reach
        left = int(pdf["_tcol"].iloc[0]) * tile - reach
        side = tile + 2 * reach
        marked = np.zeros((side, side), dtype=bool)
        marked[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = True
        # Along columns: distance to the last mark above and the next one below.
        index = np.arange(side)[:, None]
        far = 4 * side
        above = np.maximum.accumulate(np.where(marked, index, -far), axis=0)
        below = np.minimum.accumulate(np.where(marked, index, far)[::-1], axis=0)[::-1]
        gap = np.minimum(index - above, below - index)[reach : reach + tile].astype("float64")
        # Along rows: smallest squared distance over all columns in reach.
        best = np.full((tile, tile), np.inf)
        for shift in range(2 * reach + 1):
            np.minimum(
                best, gap[:, shift : shift + tile] ** 2 + (shift - reach) ** 2, out=best
            )
        row, col = np.nonzero(best <= limit)
        out = {k: [pdf[k].iloc[0]] * len(row) for k in keys}
        out["row"] = (row + top + reach).astype("int32")
        out["col"] = (col + left + reach).astype("int32")
        out["distance_m"] = np.sqrt(best[row, col]) * cell
        return pd.DataFrame(out)

    return solve


def cell_distance(cells: DataFrame, cell: float, max_distance: float,
                  keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Distance from every cell within ``max_distance`` to the nearest marked cell, centre to
    centre, in metres.

    The marked cells are shuffled by tile, each to the tiles whose margin it lies in; a tile is
    then a small dense array. A join or an explode over the neighbourhood would instead move each
    covered cell dozens of times.
    """
    keys = list(keys)
    reach = int(math.floor(max_distance / cell + 1e-9))
    tile = max(tile, reach)  # a mark belongs to at most nine tiles

    def tiles(axis: str) -> Column:
        first = F.floor((F.col(axis) - reach) / tile).cast("int")
        last = F.floor((F.col(axis) + reach) / tile).cast("int")
        return F.explode(F.sequence(first, last))

    placed = (
        cells.select(*keys, F.col("row").cast("int"), F.col("col").cast("int"))
        .withColumn("_trow", tiles("row"))
        .withColumn("_tcol", tiles("col"))
    )
    types = [f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys]
    limit = (max_distance / cell) ** 2 + 1e-9
    return placed.groupBy(*keys, "_trow", "_tcol").applyInPandas(
        _tile_solver(reach, tile, float(cell), limit, keys),
        ", ".join([*types, "row int", "col int", "distance_m double"]),
    )


def _far_solver(tile: int, cell: float):
    """Grouped function for :func:`far_distance`: distances of the open cells of one tile to the
    marked cells that may hold their nearest one."""

    def solve(left, right):
        import numpy as np
        import pandas as pd

        rows, cols = left["row"].to_numpy("float64"), left["col"].to_numpy("float64")
        marks = right[["row", "col"]].to_numpy("float64")
        best = np.full(len(left), np.inf)
        for at in range(0, len(marks), 256):
            part = marks[at : at + 256]
            near = (rows[:, None] - part[None, :, 0]) ** 2 + (cols[:, None] - part[None, :, 1]) ** 2
            np.minimum(best, near.min(axis=1), out=best)
        return pd.DataFrame(
            {"row": left["row"], "col": left["col"], "distance_m": np.sqrt(best) * cell}
        )

    return solve


def far_distance(open_cells: DataFrame, marked: DataFrame, cell: float, tile: int = 64) -> DataFrame:
    """Distance of ``open_cells`` to the nearest cell of ``marked``, however far.

    Works on tiles first: a tile's nearest marked tile bounds the distance of all its cells, and only
    marked tiles that could be nearer are joined. Tiles find their marked tiles in squares of tiles
    that double in width until the bound is covered, so a join is by equal keys.
    """
    index = lambda c: F.floor(F.col(c) / tile).cast("long")
    cells = open_cells.select("row", "col", index("row").alias("tr"), index("col").alias("tc"))
    marks = marked.select("row", "col", index("row").alias("mr"), index("col").alias("mc")).distinct()
    mark_tiles = checkpoint(marks.select("mr", "mc").distinct())
    waiting = checkpoint(cells.select("tr", "tc").distinct())
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    span = lambda f: F.hypot(f(gap("tr", "mr")), f(gap("tc", "mc")))
    nearest = span(lambda g: F.greatest(g * tile - (tile - 1), F.lit(0)))
    farthest = span(lambda g: g * tile + (tile - 1))
    pairs, width = None, 2
    while not waiting.isEmpty():
        square = lambda c: F.floor(F.col(c) / width).cast("long")  # noqa: E731, B023
        candidates = (
            waiting.withColumn("_dr", around).withColumn("_dc", around)
            .select("tr", "tc", (square("tr") + F.col("_dr")).alias("_r"), (square("tc") + F.col("_dc")).alias("_c"))
            .join(mark_tiles.withColumns({"_r": square("mr"), "_c": square("mc")}), ["_r", "_c"])
            .withColumns({"_near": nearest, "_far": farthest})
        )
        bound = candidates.groupBy("tr", "tc").agg(F.min("_far").alias("_bound"))
        # The square around a tile certainly covers all tiles up to ``width`` tiles away.
        settled = checkpoint(bound.where(F.col("_bound") <= width * tile))
        found = candidates.join(settled, ["tr", "tc"]).where(F.col("_near") <= F.col("_bound"))
        found = checkpoint(found.select("tr", "tc", "mr", "mc"))
        pairs = found if pairs is None else pairs.unionByName(found)
        waiting = checkpoint(waiting.join(settled, ["tr", "tc"], "left_anti"))
        width *= 2
    if pairs is None:
        return cells.select("row", "col", F.lit(None).cast("double").alias("distance_m"))
    wanted = pairs.join(marks, ["mr", "mc"]).select(F.col("tr").alias("_r"), F.col("tc").alias("_c"), "row", "col")
    return cells.groupBy("tr", "tc").cogroup(wanted.groupBy("_r", "_c")).applyInPandas(
        _far_solver(tile, float(cell)), "row int, col int, distance_m double"
    )


def road_distance(
    roads: DataFrame, grid: Grid, max_road_code: int = 7, max_distance: float | None = None
) -> DataFrame:
    """Distance to the nearest road of class ``<= max_road_code`` for every cell of the grid, or for
    the cells within ``max_distance``. Without any usable road an error is raised.

    Cells within 900 m are solved tile by tile; only the others look farther.
    """
    require_columns(roads, ["feature_id", "highway_code", "x1", "y1", "x2", "y2"], "roads")
    usable = roads.where(F.col("highway_code") <= max_road_code)
    if usable.isEmpty():
        raise RuntimeError(f"no road with highway_code <= {max_road_code}")
    cells = span_cells(line_spans(usable.withColumn("_all", F.lit(1)), grid, ["_all"])).drop("_all")
    if max_distance is not None:
        return cell_distance(cells, grid.cell, max_distance).where(grid.inside())
    cells = checkpoint(cells.distinct())
    near = checkpoint(cell_distance(cells, grid.cell, ROAD_BOUND_M).where(grid.inside()))
    spark = roads.sparkSession
    whole = (
        spark.range(grid.nrows).select(F.col("id").cast("int").alias("row"))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid.ncols - 1))))
    )
    far = far_distance(whole.join(near, ["row", "col"], "left_anti"), cells, grid.cell)
    return near.select("row", "col", "distance_m").unionByName(far)


def trail_density(trails: DataFrame, grid: Grid, radius_m: float = TRAIL_RADIUS_M) -> DataFrame:
    """Trail cells within the disk of ``ceil(radius/cell)`` cells, times the cell size. Cells
    without trails around them are absent (density 0)."""
    cells = span_cells(line_spans(trails.withColumn("_all", F.lit(1)), grid, ["_all"])).drop("_all")
    widths = disk_half_widths(math.ceil(radius_m / grid.cell))
    shifts = F.array(
        *[
            F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
            for dr, w in widths.items()
            for dc in range(-w, w + 1)
        ]
    )
    return (
        cells.withColumn("_s", F.explode(shifts))
        .groupBy(
            (F.col("row") + F.col("_s.dr")).alias("row"),
            (F.col("col") + F.col("_s.dc")).alias("col"),
        )
        .agg((F.count("*") * float(grid.cell)).alias("trail_m"))
        .where(grid.inside())
    )


def point_segment_distance(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> Column:
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - ax) * dx + (py - ay) * dy) / length2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _cells_near(e: DataFrame, grid: Grid, reach: float, keys: Sequence[str]) -> DataFrame:
    """Cells whose centre may lie within ``reach`` grid units of a segment: for each row the
    column range of the segment part within the row band, widened by the reach.

    Segments are cut into bands of ``BAND`` rows and dealt by (keys, ``_band``) before they become cells, as many
    tasks as the cells need; grouping by these columns and more moves no cell again.
    """
    low = F.ceil(F.least("ay", "by") - reach - 0.5)
    high = F.floor(F.greatest("ay", "by") + reach - 0.5)
    low = F.greatest(low, F.lit(0)).cast("int")
    if grid.nrows is not None:
        high = F.least(high, F.lit(grid.nrows - 1))
    high = high.cast("int")
    flat = F.col("ay") == F.col("by")
    y0 = F.greatest(F.least("ay", "by"), F.col("row") + 0.5 - reach)
    y1 = F.least(F.greatest("ay", "by"), F.col("row") + 0.5 + reach)
    at = lambda y: F.when(flat, F.col("ax")).otherwise(
        F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    )
    xa = F.when(flat, F.least("ax", "bx")).otherwise(F.least(at(y0), at(y1)))
    xb = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(at(y0), at(y1)))
    c0 = F.greatest(F.ceil(xa - reach - 0.5), F.lit(0)).cast("int")
    c1 = F.floor(xb + reach - 0.5)
    if grid.ncols is not None:
        c1 = F.least(c1, F.lit(grid.ncols - 1))
    bands = F.sequence(F.floor(F.col("_low") / BAND).cast("int"), F.floor(F.col("_high") / BAND).cast("int"))
    banded = (
        e.withColumns({"_low": low, "_high": high})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_band", F.explode(bands))
        .withColumns({
            "_low": F.greatest(F.col("_low"), F.col("_band") * BAND),
            "_high": F.least(F.col("_high"), F.col("_band") * BAND + BAND - 1),
        })
    )
    across, down = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))
    width = F.least(across, F.coalesce(F.try_divide(across, down) * (1.0 + 2.0 * reach), across)) + 2.0 * reach + 1.0
    return (
        spread(banded, (F.col("_high") - F.col("_low") + 1) * width, *keys, "_band")
        .withColumn("row", F.explode(F.sequence("_low", "_high")))
        .withColumns({"_c0": c0, "_c1": c1.cast("int")})
        .where(F.col("_c0") <= F.col("_c1"))
        .withColumn("col", F.explode(F.sequence("_c0", "_c1")))
        .drop("_low", "_high", "_c0", "_c1")
    )


def line_cell_distance(
    edges: DataFrame, grid: Grid, max_distance: float, keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """Exact distance from cell centres to each line, for cells within ``max_distance``."""
    keys = list(keys)
    reach = max_distance / grid.cell
    near = _cells_near(grid_edges(edges, grid, keys), grid, reach, keys)
    d = point_segment_distance(
        F.col("col") + 0.5, F.col("row") + 0.5,
        F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"),
    ) * float(grid.cell)
    return (
        near.withColumn("distance_m", d)
        .where(F.col("distance_m") <= max_distance)
        .groupBy(*keys, "_band", "row", "col")
        .agg(F.min("distance_m").alias("distance_m"))
        .drop("_band")
    )


def buffer_zones(
    cell_distances: DataFrame, distances: Sequence[float], keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """Cells of the buffer zone of each line at each distance, from one distance table."""
    wanted = F.filter(
        F.array(*[F.lit(float(d)) for d in distances]), lambda d: d >= F.col("distance_m")
    )
    return cell_distances.select(*keys, "row", "col", F.explode(wanted).alias("buffer_m"))


def nested_zone_means(
    valued: DataFrame, distances: Mapping[str, float], value: str, keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """Mean of ``value`` over the cells within each distance (column name → metres), one column per distance.

    Zones are nested, so a cell is counted once, for the ring it lies in; a zone is the sum of the rings inside it.
    """
    limits = sorted(set(map(float, distances.values())))
    inner = F.size(F.filter(F.array(*[F.lit(d) for d in limits]), lambda d: d < F.col("distance_m")))
    rings = valued.withColumn("_ring", inner).where(F.col("_ring") < len(limits)).groupBy(*keys, "_ring").agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )

    def mean(distance: float) -> Column:
        held = F.col("_ring") <= limits.index(float(distance))
        return F.try_divide(F.sum(F.when(held, F.col("_sum"))), F.sum(F.when(held, F.col("_n"))))

    return rings.groupBy(*keys).agg(*[mean(d).alias(name) for name, d in distances.items()])


def nearest_line_cells(cell_distances: DataFrame, key: str = "feature_id") -> DataFrame:
    """Overlapping buffers resolved: each cell belongs to its nearest line (smallest id on ties)."""
    return cell_distances.groupBy("row", "col").agg(
        F.min_by(key, F.struct(F.col("distance_m"), F.col(key))).alias(key),
        F.min("distance_m").alias("distance_m"),
    )


def line_length_in_circle(
    edges: DataFrame, grid: Grid, radius_m: float = CIRCLE_RADIUS_M
) -> DataFrame:
    """True length of all lines inside the circle around each cell centre (metres)."""
    reach = radius_m / grid.cell
    near = _cells_near(grid_edges(edges, grid, []), grid, reach, [])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    fx, fy = F.col("ax") - (F.col("col") + 0.5), F.col("ay") - (F.col("row") + 0.5)
    a = dx * dx + dy * dy
    b = 2.0 * (fx * dx + fy * dy)
    c = fx * fx + fy * fy - reach * reach
    disc = b * b - 4.0 * a * c
    root = F.sqrt(disc)
    t0 = F.greatest(F.lit(0.0), (-b - root) / (2.0 * a))
    t1 = F.least(F.lit(1.0), (-b + root) / (2.0 * a))
    part = F.when((a > 0) & (disc > 0), F.greatest(F.lit(0.0), t1 - t0) * F.sqrt(a))
    return (
        near.withColumn("_len", part * float(grid.cell))
        .where(F.col("_len") > 0)
        .groupBy("_band", "row", "col")
        .agg(F.sum("_len").alias("trail_m"))
        .drop("_band")
    )

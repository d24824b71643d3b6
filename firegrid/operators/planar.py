"""Exact measures of polygons on tiles: areas shared by two layers, lengths of lines inside polygons.

A polygon is the signed sum of the strips below its edges: an edge that has the inside below it adds its strip,
one that has it above takes it off. On a tile the strips end at its lower border, and what lies above the tile is
one horizontal edge along its upper border wherever the polygon covers that border. So every tile that a
polygon meets holds a few weighted edges, a tile inside it just one, and tiles need nothing from each other.
The area that two polygons share is the sum, over pairs of weighted edges of one tile, of the product of
the weights and of the area below both edges. No intersection is constructed and no point is located, so
slivers, shared borders and touching vertices need no tolerance; results don't depend on the tiles. Sums are rounded
to the micrometre squared, far above their error, so that an area compares with a limit that it meets exactly.

Edges are directed with the inside on the left (:func:`oriented`). Parts of one feature must not overlap
(``arrangement.make_valid`` repairs those that do).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns
from .geometry import ring_areas

COORDINATES = ("x1", "y1", "x2", "y2")
LEAST_M2 = 1e-6
DIGITS_M2 = 6


def oriented(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Edges with the inside on their left: outer rings (ring 0) counterclockwise, holes clockwise. ``seq``
    counts backwards in rings that were turned. Rings without area go."""
    ring = [*keys, "part", "ring"]
    require_columns(edges, [*ring, "seq", *COORDINATES], "edges")
    turned = ring_areas(edges, keys).where(F.col("signed") != 0)
    turned = turned.select(*ring, ((F.col("signed") > 0) != (F.col("ring") == 0)).alias("_turned"))
    pick = lambda a, b: F.when(F.col("_turned"), F.col(b)).otherwise(F.col(a))
    return edges.join(turned, ring).select(
        *ring,
        F.when(F.col("_turned"), -F.col("seq")).otherwise(F.col("seq")).alias("seq"),
        pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"),
        pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"),
    )


def pieces_in_tiles(edges: DataFrame, tile: float, keep: Sequence[str]) -> DataFrame:
    """Edges cut at the tiles' borders, with ``row`` and ``col`` of the tile (rows count upward) and
    coordinates from its lower left corner."""
    tile = float(tile)
    edges = edges.withColumns({f"_{c}": F.col(c) / tile for c in COORDINATES})

    def cuts(a: str, b: str) -> Column:
        low, high = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
        lines = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda g: (g - F.col(a)) / (F.col(b) - F.col(a)))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    ts = F.array_sort(F.array_distinct(F.concat(ends, cuts("_x1", "_x2"), cuts("_y1", "_y2"))))
    cut = edges.withColumn("_ts", ts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_ts") - 1)))
    cut = cut.withColumns({"_t0": F.get("_ts", F.col("_i") - 1), "_t1": F.get("_ts", F.col("_i"))})
    # Ends keep their coordinates to the last digit: equal ones must stay equal in every tile.
    at = lambda a, b, t: F.when(F.col(t) == 1, F.col(b)).otherwise(F.col(a) + F.col(t) * (F.col(b) - F.col(a)))
    cut = cut.withColumns({
        "_ax": at("x1", "x2", "_t0"), "_ay": at("y1", "y2", "_t0"), "_bx": at("x1", "x2", "_t1"), "_by": at("y1", "y2", "_t1"),
    })
    cut = cut.withColumns({
        "row": F.floor((F.col("_ay") + F.col("_by")) / 2.0 / tile), "col": F.floor((F.col("_ax") + F.col("_bx")) / 2.0 / tile),
    })
    inside = lambda v, corner: F.least(F.greatest(F.col(v) - F.col(corner) * tile, F.lit(0.0)), F.lit(tile))
    return cut.select(
        *keep, "row", "col",
        inside("_ax", "col").alias("x1"), inside("_ay", "row").alias("y1"),
        inside("_bx", "col").alias("x2"), inside("_by", "row").alias("y2"),
    )


def covered_borders(edges: DataFrame, tile: float, keys: Sequence[str]) -> DataFrame:
    """Stretches of the tiles' upper borders inside the polygons (just below the line), with their winding.

    Along every line between rows the edges that meet it are summed up from the left; ``w`` is the
    edges' own weight.
    """
    keys, tile = list(keys), float(tile)
    low, high = F.floor(F.least("y1", "y2") / tile) + 1, F.floor(F.greatest("y1", "y2") / tile)
    met = edges.where(low <= high).withColumn("_line", F.explode(F.sequence(low, high)))
    share = F.try_divide(F.col("_line") * tile - F.col("y1"), F.col("y2") - F.col("y1"))
    met = met.select(
        *keys, "_line",
        (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("_x"),
        (F.when(F.col("y2") < F.col("y1"), F.col("w")).otherwise(-F.col("w"))).alias("_turn"),
    )
    along = Window.partitionBy(*keys, "_line").orderBy("_x")
    runs = met.withColumns({"w": F.sum("_turn").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_end": F.lead("_x").over(along)})
    runs = runs.where((F.col("w") != 0) & (F.col("_end") > F.col("_x")))
    runs = runs.withColumn("col", F.explode(F.sequence(F.floor(F.col("_x") / tile), F.ceil(F.col("_end") / tile) - 1)))
    return runs.select(
        *keys, (F.col("_line") - 1).alias("row"), "col",
        F.greatest(F.col("_x") - F.col("col") * tile, F.lit(0.0)).alias("x1"), F.lit(tile).alias("y1"),
        F.least(F.col("_end") - F.col("col") * tile, F.lit(tile)).alias("x2"), F.lit(tile).alias("y2"), "w",
    )


def strips(edges: DataFrame, tile: float, keep: Sequence[str]) -> DataFrame:
    """(keep, row, col, x1, y1, x2, y2, w): pieces of directed edges in tiles from left to right, with the weight of the
    strip below. Upright pieces and pieces along a tile's lower border have no strip."""
    pieces = pieces_in_tiles(edges, tile, [*keep, "w"]).where((F.col("x1") != F.col("x2")) & ((F.col("y1") > 0) | (F.col("y2") > 0)))
    right = F.col("x1") < F.col("x2")
    pick = lambda a, b: F.when(right, F.col(a)).otherwise(F.col(b))
    return pieces.select(
        *keep, "row", "col", pick("x1", "x2").alias("x1"), pick("y1", "y2").alias("y1"), pick("x2", "x1").alias("x2"), pick("y2", "y1").alias("y2"),
        F.when(right, -F.col("w")).otherwise(F.col("w")).alias("w"),
    )


def weighted_edges(edges: DataFrame, tile: float, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """(keys, row, col, x1, y1, x2, y2, w): the edges whose strips add up to the polygons on every tile.

    ``edges`` are directed; an optional column ``w`` counts each so many times. ``x1 < x2`` in the result.
    """
    keys = list(keys)
    if "w" not in edges.columns:
        edges = edges.withColumn("w", F.lit(1).cast("long"))
    edges = edges.select(*keys, *COORDINATES, "w")
    return strips(edges, tile, keys).unionByName(covered_borders(edges, tile, keys))


def _height(prefix: str, x: Column) -> Column:
    x1, y1, x2, y2 = (F.col(f"{prefix}{c}") for c in COORDINATES)
    return y1 + (x - x1) / (x2 - x1) * (y2 - y1)


def shared_areas(left: DataFrame, right: DataFrame, tile: float, left_key: str, right_key: str, least_m2: float = LEAST_M2) -> DataFrame:
    """(left_key, right_key, area_m2) of every pair of features that share more than ``least_m2``.

    Both layers are directed edges. The tiles are the join key; about the size of a typical feature is best.
    """
    a = weighted_edges(left, tile, [left_key]).withColumnsRenamed({c: f"_a{c}" for c in (*COORDINATES, "w")})
    b = weighted_edges(right, tile, [right_key]).withColumnsRenamed({c: f"_b{c}" for c in (*COORDINATES, "w")})
    lo, hi = F.greatest("_ax1", "_bx1"), F.least("_ax2", "_bx2")
    pairs = a.join(b, ["row", "col"]).where(lo < hi).withColumns({"_lo": lo, "_hi": hi})
    pairs = pairs.withColumns({
        "_a0": _height("_a", F.col("_lo")), "_a1": _height("_a", F.col("_hi")), "_b0": _height("_b", F.col("_lo")), "_b1": _height("_b", F.col("_hi")),
    })
    d0, d1 = F.col("_a0") - F.col("_b0"), F.col("_a1") - F.col("_b1")
    cross = F.try_divide(d0, d0 - d1)
    low0, low1, middle = F.least("_a0", "_b0"), F.least("_a1", "_b1"), F.col("_a0") + cross * (F.col("_a1") - F.col("_a0"))
    mean = F.when(d0 * d1 < 0, (cross * (low0 + middle) + (1.0 - cross) * (middle + low1)) / 2.0).otherwise((low0 + low1) / 2.0)
    below = mean * (F.col("_hi") - F.col("_lo")) * F.col("_aw") * F.col("_bw")
    return pairs.groupBy(left_key, right_key).agg(F.round(F.sum(below), DIGITS_M2).alias("area_m2")).where(F.col("area_m2") > least_m2)


def lengths_inside(
    lines: DataFrame, polygons: DataFrame, tile: float, line_key: str, polygon_key: str, least_m: float = LEAST_M2
) -> DataFrame:
    """(line_key, polygon_key, length_m): length of the lines inside the polygons.

    A stretch along a border belongs to the polygon above it, on a vertical border to the one on its right.
    """
    p = pieces_in_tiles(lines.select(line_key, *COORDINATES), tile, [line_key]).withColumnsRenamed({c: f"_p{c}" for c in COORDINATES})
    e = weighted_edges(polygons, tile, [polygon_key]).withColumnsRenamed({c: f"_e{c}" for c in (*COORDINATES, "w")})
    dx, dy = F.col("_px2") - F.col("_px1"), F.col("_py2") - F.col("_py1")
    # The stretch (t from, to) of the piece over the edge.
    ta, tb = (F.try_divide(F.col(c) - F.col("_px1"), dx) for c in ("_ex1", "_ex2"))
    upright = (F.col("_ex1") <= F.col("_px1")) & (F.col("_px1") < F.col("_ex2"))
    start = F.when(dx == 0, F.when(upright, 0.0).otherwise(1.0)).otherwise(F.greatest(F.least(ta, tb), F.lit(0.0)))
    end = F.when(dx == 0, F.lit(1.0)).otherwise(F.least(F.greatest(ta, tb), F.lit(1.0)))
    met = p.join(e, ["row", "col"]).withColumns({"_t0": start, "_t1": end}).where("_t0 < _t1")
    over = lambda t: _height("_e", F.col("_px1") + F.col(t) * dx) - (F.col("_py1") + F.col(t) * dy)
    met = met.withColumns({"_f0": over("_t0"), "_f1": over("_t1")})
    f0, f1 = F.col("_f0"), F.col("_f1")
    share = (
        F.when((f0 <= 0) & (f1 <= 0), 0.0).when((f0 >= 0) & (f1 >= 0), 1.0)
        .when(f0 > 0, F.try_divide(f0, f0 - f1)).otherwise(F.try_divide(f1, f1 - f0))
    )
    length = share * (F.col("_t1") - F.col("_t0")) * F.hypot(dx, dy) * F.col("_ew")
    return met.groupBy(line_key, polygon_key).agg(F.sum(length).alias("length_m")).where(F.col("length_m") > least_m)


def directed_areas(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area_m2) of directed edges; sums are taken from each feature's first corner."""
    corner = Window.partitionBy(*keys)
    at = edges.withColumns({"_ox": F.min("x1").over(corner), "_oy": F.min("y1").over(corner)})
    x1, x2, y1, y2 = F.col("x1") - F.col("_ox"), F.col("x2") - F.col("_ox"), F.col("y1") - F.col("_oy"), F.col("y2") - F.col("_oy")
    return at.groupBy(*keys).agg((F.sum(x1 * y2 - x2 * y1) / 2.0).alias("area_m2"))

"""Polygons, lines and points on the grid as *row spans*.

A span ``(feature_id, row, c0, c1)`` stands for the cells ``c0..c1`` of one raster row. Spans are
an order of magnitude fewer than pixels, intersect by interval arithmetic, and join to pixel
tables on (row, column block), so neither side is compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_COLUMNS, Grid, require_columns
from ..session import BROADCAST_ROWS, checkpoint

BLOCK = 256


def grid_edges(edges: DataFrame, grid: Grid, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Edges in grid coordinates (one unit per cell, y growing downward)."""
    require_columns(edges, [*keys, *EDGE_COLUMNS[1:]], "edges")
    return edges.select(
        *keys,
        grid.gx("x1").alias("ax"),
        grid.gy("y1").alias("ay"),
        grid.gx("x2").alias("bx"),
        grid.gy("y2").alias("by"),
    )


def _clip_rows(low: Column, high: Column, grid: Grid) -> tuple[Column, Column]:
    low = F.greatest(low, F.lit(0))
    if grid.nrows is not None:
        high = F.least(high, F.lit(grid.nrows - 1))
    return low.cast("int"), high.cast("int")


def _clip_cols(df: DataFrame, grid: Grid) -> DataFrame:
    c1 = F.col("c1")
    if grid.ncols is not None:
        c1 = F.least(c1, F.lit(grid.ncols - 1))
    return df.withColumns(
        {"c0": F.greatest(F.col("c0"), F.lit(0)).cast("int"), "c1": c1.cast("int")}
    ).where(F.col("c0") <= F.col("c1"))


def polygon_spans(
    edges: DataFrame, grid: Grid, keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """Spans of the cells whose centre lies inside each polygon (even-odd rule, so holes and
    several parts need no special case). Work grows with the rows an edge crosses."""
    keys = list(keys)
    e = grid_edges(edges, grid, keys)
    top = F.ceil(F.least("ay", "by") - 0.5)
    bottom = F.ceil(F.greatest("ay", "by") - 0.5) - 1
    low, high = _clip_rows(top, bottom, grid)
    crossings = (
        e.withColumns({"_low": low, "_high": high})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("row", F.explode(F.sequence("_low", "_high")))
        .select(
            *keys,
            "row",
            (
                F.col("ax")
                + (F.col("row") + 0.5 - F.col("ay"))
                * (F.col("bx") - F.col("ax"))
                / (F.col("by") - F.col("ay"))
            ).alias("x"),
        )
    )
    scan = Window.partitionBy(*keys, "row").orderBy("x")
    paired = (
        crossings.withColumns(
            {"_k": F.row_number().over(scan), "_next": F.lead("x").over(scan)}
        )
        .where((F.col("_k") % 2 == 1) & F.col("_next").isNotNull())
        .select(
            *keys,
            "row",
            F.ceil(F.col("x") - 0.5).alias("c0"),
            (F.ceil(F.col("_next") - 0.5) - 1).alias("c1"),
        )
    )
    return _clip_cols(paired, grid)


def line_spans(edges: DataFrame, grid: Grid, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Spans of every cell a segment passes through. A cell owns its top and left border."""
    keys = list(keys)
    e = grid_edges(edges, grid, keys)
    low, high = _clip_rows(F.floor(F.least("ay", "by")), F.floor(F.greatest("ay", "by")), grid)

    def x_at(y: Column) -> Column:
        share = (y - F.col("ay")) / (F.col("by") - F.col("ay"))
        return F.col("ax") + share * (F.col("bx") - F.col("ax"))

    flat = F.col("ay") == F.col("by")
    upper = F.greatest(F.col("row").cast("double"), F.least("ay", "by"))
    lower = F.least(F.col("row") + 1.0, F.greatest("ay", "by"))
    xa = F.when(flat, F.col("ax")).otherwise(x_at(upper))
    xb = F.when(flat, F.col("bx")).otherwise(x_at(lower))
    # Where the segment leaves through the bottom of the row, that end belongs to the next row.
    leaves = ~flat & (F.col("row") + 1.0 <= F.greatest("ay", "by")) & (F.col("_xb") > F.col("_xa"))
    spans = (
        e.withColumns({"_low": low, "_high": high})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("row", F.explode(F.sequence("_low", "_high")))
        .withColumns({"_xa": xa, "_xb": xb})
        .select(
            *keys,
            "row",
            F.floor(F.least("_xa", "_xb")).alias("c0"),
            F.when(leaves, F.ceil("_xb") - 1).otherwise(F.floor(F.greatest("_xa", "_xb"))).alias("c1"),
        )
    )
    return merge_spans(_clip_cols(spans, grid), keys)


def merge_spans(spans: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Union of overlapping or touching spans of the same feature, so each cell counts once."""
    keys = list(keys)
    scan = Window.partitionBy(*keys, "row").orderBy("c0", "c1")
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(
        (F.col("c0") > F.max("c1").over(before) + 1).cast("int"), F.lit(1)
    )
    return (
        spans.withColumn("_start", starts)
        .withColumn("_island", F.sum("_start").over(scan))
        .groupBy(*keys, "row", "_island")
        .agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
        .drop("_island")
    )


def touched_spans(
    edges: DataFrame, grid: Grid, keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """All-touched rule: cells with their centre inside plus cells crossed by the boundary."""
    both = polygon_spans(edges, grid, keys).unionByName(line_spans(edges, grid, keys))
    return merge_spans(both, keys)


def dissolve_spans(spans: DataFrame, group: Sequence[str]) -> DataFrame:
    """Union of all features with the same ``group`` values."""
    return merge_spans(spans.select(*group, "row", "c0", "c1"), group)


def point_cells(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Cell of each point; points off the grid are dropped."""
    return points.withColumns(
        {"row": F.floor(grid.gy(y)).cast("int"), "col": F.floor(grid.gx(x)).cast("int")}
    ).where(grid.inside())


def blocked(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cut spans at multiples of ``block`` columns and add the block number ``_blk``."""
    first = F.floor(F.col("c0") / block).cast("int")
    last = F.floor(F.col("c1") / block).cast("int")
    return spans.withColumn("_blk", F.explode(F.sequence(first, last))).withColumns(
        {
            "c0": F.greatest(F.col("c0"), F.col("_blk") * block),
            "c1": F.least(F.col("c1"), F.col("_blk") * block + block - 1),
        }
    )


def span_cells(spans: DataFrame) -> DataFrame:
    """One row per covered cell."""
    return spans.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def join_pixels(
    pixels: DataFrame,
    spans: DataFrame,
    how: str = "inner",
    on: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Pixels with the features covering them (one row per pixel and covering feature).

    ``on`` names further key columns both sides share. The spans are stored and measured first:
    up to the broadcast bound they are replicated and the pixel table is not moved at all; beyond
    it both sides are shuffled on (row, column block), which spreads even a feature that covers a
    third of all pixels.
    """
    pieces = checkpoint(blocked(spans, block).withColumnRenamed("row", "_srow"))
    size = pieces.agg(
        F.count("*").alias("n"), F.min("_srow"), F.max("_srow"), F.min("c0"), F.max("c1")
    ).first()
    if size["n"] <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    if how in ("inner", "left_semi") and size["n"] > 0:
        # The features' bounding box prunes row groups of the pixel files before the join.
        _, r0, r1, k0, k1 = size
        pixels = pixels.where(F.col("row").between(r0, r1) & F.col("col").between(k0, k1))
    condition = (
        (F.col("row") == F.col("_srow"))
        & (F.floor(F.col("col") / block).cast("int") == F.col("_blk"))
        & F.col("col").between(F.col("c0"), F.col("c1"))
    )
    if on:
        pieces = pieces.withColumnsRenamed({k: f"_on_{k}" for k in on})
        for k in on:
            condition = condition & (F.col(k) == F.col(f"_on_{k}"))
    out = pixels.join(pieces, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(
        "_srow", "_blk", "c0", "c1", *[f"_on_{k}" for k in on]
    )


def disjoint_spans(
    spans: DataFrame,
    attrs: DataFrame,
    zone: str = "feature_id",
    order: str = "ord",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Zone grid as spans: each cell belongs to the last zone (by ``order``) covering it, within
    each combination of ``keys`` (attributes such as the treatment type).

    Spans that overlap no other span of their row pass through whole; only contested stretches
    are taken apart into cells. Every step is clustered by (keys, row), so there is one shuffle.
    """
    keys = list(keys)
    require_columns(attrs, [zone, order, *keys], "features")
    tagged = spans.select(zone, "row", "c0", "c1").join(attrs.select(zone, order, *keys), zone)
    along = Window.partitionBy(*keys, "row").orderBy("c0", "c1", zone)
    reach = F.max("c1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    group = Window.partitionBy(*keys, "row", "_island")
    contested = (
        tagged.withColumn("_start", F.coalesce((F.col("c0") > reach).cast("int"), F.lit(1)))
        .withColumn("_island", F.sum("_start").over(along))
        .withColumn("_alone", F.count("*").over(group) == 1)
    )
    pieces = contested.withColumn(
        "_c", F.explode(F.when(F.col("_alone"), F.array("c0")).otherwise(F.sequence("c0", "c1")))
    ).withColumn("c1", F.when(F.col("_alone"), F.col("c1")).otherwise(F.col("_c")))
    winner = F.max_by(F.struct(zone, "c1"), F.struct(F.col(order), F.col(zone)))
    resolved = (
        pieces.groupBy(*keys, "row", F.col("_c").alias("c0"))
        .agg(winner.alias("_w"))
        .select(*keys, F.col(f"_w.{zone}").alias(zone), "row", "c0", F.col("_w.c1").alias("c1"))
    )
    return merge_spans(resolved, [*keys, zone])


def zone_pixels(
    spans: DataFrame, attrs: DataFrame, zone: str = "feature_id", order: str = "ord"
) -> DataFrame:
    """One zone per cell: where zones overlap, the last one in feature order wins."""
    return span_cells(disjoint_spans(spans, attrs, zone, order)).select("row", "col", zone)


def clip_pixels(pixels: DataFrame, spans: DataFrame, crop: bool = False) -> DataFrame:
    """Pixels whose centre lies inside any of the features; with ``crop``, all pixels of the
    features' common bounding box."""
    if not crop:
        return join_pixels(pixels, spans, how="left_semi")
    box = spans.agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"),
        F.min("c0").alias("_k0"), F.max("c1").alias("_k1"),
    ).first()
    if box["_r0"] is None:
        return pixels.where(F.lit(False))
    return pixels.where(
        F.col("row").between(box["_r0"], box["_r1"]) & F.col("col").between(box["_k0"], box["_k1"])
    )

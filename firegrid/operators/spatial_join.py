"""Point-in-polygon, within-distance and nearest-point joins as tile equi-joins."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Grid, require_columns
from ..session import broadcast_if_small, checkpoint, spread
from .distance import point_segment_distance


# Where inside a tile its reference point lies. Off the simple fractions, so that it does not
# line up with vertices of digitized features.
_ANCHOR_X, _ANCHOR_Y = 0.500731, 0.500419

# Points and edges of a task: each meets all edges of its tile.
TASK_POINTS = 20_000


def _tile_grid(tile: float) -> Grid:
    return Grid(x0=0.0, y0=0.0, cell=float(tile))


def _tile_of(c: Column | str, tile: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / float(tile)).cast("int")


def _tiles_between(low: Column, high: Column, tile: float) -> Column:
    return F.explode(F.sequence(_tile_of(low, tile), _tile_of(high, tile)))


def _edges_by_tile(edges: DataFrame, tile: float, keys: Sequence[str], reach: float = 0.0):
    """Each edge once per tile of its bounding box widened by ``reach``, dealt to tasks by the number of these tiles."""
    cells = lambda a, b: (F.abs(F.col(a) - F.col(b)) + 2.0 * reach) / float(tile) + 1.0
    dealt = spread(edges, cells("x1", "x2") * cells("y1", "y2"), *keys, "x1", "y1", per_task=TASK_POINTS)
    return dealt.withColumn(
        "_tx", _tiles_between(F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach, tile)
    ).withColumn(
        "_ty", _tiles_between(F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach, tile)
    ).select(*keys, "_tx", "_ty", "x1", "y1", "x2", "y2")


def _anchor_tiles(edges: DataFrame, tile: float, key: str) -> DataFrame:
    """Tiles whose reference point lies inside the polygon: the scanline at tile resolution,
    shifted so that cell centres fall on the reference points."""
    e = edges.select(
        key,
        ((F.col("x1") / tile) - _ANCHOR_X).alias("ax"),
        ((F.col("y1") / tile) - _ANCHOR_Y).alias("ay"),
        ((F.col("x2") / tile) - _ANCHOR_X).alias("bx"),
        ((F.col("y2") / tile) - _ANCHOR_Y).alias("by"),
    )
    low = F.ceil(F.least("ay", "by")).cast("int")
    high = (F.ceil(F.greatest("ay", "by")) - 1).cast("int")
    scan = Window.partitionBy(key, "_ty").orderBy("_x")
    return (
        e.withColumns({"_low": low, "_high": high})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_ty", F.explode(F.sequence("_low", "_high")))
        .withColumn(
            "_x",
            F.col("ax")
            + (F.col("_ty") - F.col("ay")) / (F.col("by") - F.col("ay"))
            * (F.col("bx") - F.col("ax")),
        )
        .withColumns({"_k": F.row_number().over(scan), "_next": F.lead("_x").over(scan)})
        .where((F.col("_k") % 2 == 1) & F.col("_next").isNotNull())
        .withColumns(
            {"_c0": F.ceil("_x").cast("int"), "_c1": (F.ceil("_next") - 1).cast("int")}
        )
        .where(F.col("_c0") <= F.col("_c1"))
        .select(key, "_ty", F.explode(F.sequence("_c0", "_c1")).alias("_tx"))
    )


def points_in_polygons(
    points: DataFrame,
    edges: DataFrame,
    tile: float,
    key: str = "feature_id",
    point_id: str = "point_id",
    how: str = "inner",
) -> DataFrame:
    """Points with each polygon they lie in; ``how="left"`` keeps points outside all polygons.

    A point is joined only to the polygons of its tile. Tiles without any edge are decided by
    their reference point alone; elsewhere the parity of the edges between the reference point
    and the point decides, so only edges of the same tile are looked at.
    """
    require_columns(points, [point_id, "x", "y"], "points")
    tiled_edges = _edges_by_tile(edges, tile, [key])
    border = tiled_edges.select(key, "_tx", "_ty").distinct().withColumn("_border", F.lit(True))
    anchors = _anchor_tiles(edges, tile, key).withColumn("_in", F.lit(True))
    tiles = anchors.join(border, [key, "_tx", "_ty"], "full_outer").select(
        key, "_tx", "_ty", F.coalesce("_in", F.lit(False)).alias("_in"),
        F.coalesce("_border", F.lit(False)).alias("_border"),
    )
    geometry = tiles.join(tiled_edges, [key, "_tx", "_ty"], "left")
    dealt = spread(points.select(point_id, "x", "y"), 1, point_id, per_task=TASK_POINTS)
    placed = dealt.select(
        point_id, "x", "y", _tile_of("x", tile).alias("_tx"), _tile_of("y", tile).alias("_ty")
    )
    px, py = F.col("x"), F.col("y")
    ax = (F.col("_tx") + _ANCHOR_X) * float(tile)
    ay = (F.col("_ty") + _ANCHOR_Y) * float(tile)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    # Walk from the reference point along y = ay to the point's x, then along that x.
    spans_y = (y1 <= ay) != (y2 <= ay)
    cross_x = x1 + (ay - y1) / (y2 - y1) * (x2 - x1)
    leg1 = F.when(spans_y, (cross_x <= ax) != (cross_x <= px))
    spans_x = (x1 <= px) != (x2 <= px)
    cross_y = y1 + (px - x1) / (x2 - x1) * (y2 - y1)
    leg2 = F.when(spans_x, (cross_y <= ay) != (cross_y <= py))
    crossings = F.coalesce(leg1.cast("int"), F.lit(0)) + F.coalesce(leg2.cast("int"), F.lit(0))
    inside = (
        placed.join(broadcast_if_small(geometry), ["_tx", "_ty"])
        .groupBy(point_id, key)
        .agg(F.first("_in").alias("_in"), F.sum(crossings).alias("_n"))
        .where(F.col("_in") != (F.col("_n") % 2 == 1))
        .select(point_id, key)
    )
    return points.join(inside, point_id, how)


def points_within_distance(
    points: DataFrame,
    edges: DataFrame,
    distance: float,
    key: str = "feature_id",
    point_id: str = "point_id",
    tile: float = 1000.0,
) -> DataFrame:
    """(point, polygon) pairs where the point lies in the polygon or within ``distance`` of it.
    A point near several polygons appears once for each. Tiles are at least as wide as the
    distance."""
    tile = float(max(distance, tile))
    near_edges = _edges_by_tile(edges, tile, [key], reach=distance)
    dealt = spread(points.select(point_id, "x", "y"), 1, point_id, per_task=TASK_POINTS)
    placed = dealt.select(
        point_id, "x", "y", _tile_of("x", tile).alias("_tx"), _tile_of("y", tile).alias("_ty")
    )
    d = point_segment_distance(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    near = (
        placed.join(broadcast_if_small(near_edges), ["_tx", "_ty"])
        .where(d <= distance)
        .select(point_id, key)
    )
    inside = points_in_polygons(points.select(point_id, "x", "y"), edges, tile, key, point_id)
    pairs = near.unionByName(inside.select(point_id, key)).distinct()
    return points.join(pairs, point_id)


def _segments_meet() -> Column:
    """Whether segments (x1,y1)-(x2,y2) and (u1,v1)-(u2,v2) cross."""

    def side(ax, ay, bx, by, cx, cy):
        return F.signum(
            (F.col(bx) - F.col(ax)) * (F.col(cy) - F.col(ay))
            - (F.col(by) - F.col(ay)) * (F.col(cx) - F.col(ax))
        )

    a = side("x1", "y1", "x2", "y2", "u1", "v1") * side("x1", "y1", "x2", "y2", "u2", "v2")
    b = side("u1", "v1", "u2", "v2", "x1", "y1") * side("u1", "v1", "u2", "v2", "x2", "y2")
    return (a < 0) & (b < 0)


def near_line_flag(
    polygons: DataFrame, lines: DataFrame, distance: float = 300.0, key: str = "feature_id",
    tile: float = 1000.0,
) -> DataFrame:
    """Per polygon: ``Line`` when it comes within ``distance`` of any line segment (or holds
    one), else ``Interior``. Tiles are at least as wide as the distance."""
    tile = float(max(distance, tile))
    segs = lines.select(
        F.col("x1").alias("u1"), F.col("y1").alias("v1"),
        F.col("x2").alias("u2"), F.col("y2").alias("v2"),
    )
    seg_tiles = (
        segs.withColumn("_tx", _tiles_between(F.least("u1", "u2") - distance,
                                              F.greatest("u1", "u2") + distance, tile))
        .withColumn("_ty", _tiles_between(F.least("v1", "v2") - distance,
                                          F.greatest("v1", "v2") + distance, tile))
        .distinct()
    )
    poly_tiles = _edges_by_tile(polygons, tile, [key])
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2")}
    d = F.least(
        point_segment_distance(c["x1"], c["y1"], c["u1"], c["v1"], c["u2"], c["v2"]),
        point_segment_distance(c["x2"], c["y2"], c["u1"], c["v1"], c["u2"], c["v2"]),
        point_segment_distance(c["u1"], c["v1"], c["x1"], c["y1"], c["x2"], c["y2"]),
        point_segment_distance(c["u2"], c["v2"], c["x1"], c["y1"], c["x2"], c["y2"]),
    )
    # Boxes first: most pairs of a tile are far apart, and the distances cost much more than a comparison.
    slack = distance * (1.0 + 1e-9)
    apart = lambda a, b, u, v: (F.least(a, b) - F.greatest(u, v) > slack) | (F.least(u, v) - F.greatest(a, b) > slack)
    close = (
        poly_tiles.join(broadcast_if_small(seg_tiles), ["_tx", "_ty"])
        .where(~apart("x1", "x2", "u1", "u2") & ~apart("y1", "y2", "v1", "v2"))
        .where((d <= distance) | _segments_meet())
        .select(key)
    )
    starts = segs.select(
        F.col("u1").alias("x"), F.col("v1").alias("y")
    ).distinct().withColumn("point_id", F.struct("x", "y"))
    held = points_in_polygons(starts, polygons, tile, key).select(key)
    hit = close.unionByName(held).distinct().withColumn("_hit", F.lit(True))
    return (
        polygons.select(key)
        .distinct()
        .join(hit, key, "left")
        .select(
            key,
            F.when(F.col("_hit"), F.lit("Line")).otherwise(F.lit("Interior")).alias("pod_line"),
        )
    )


def wedge_edges(
    centers: DataFrame,
    key: str = "feature_id",
    wind: str = "wind_direction",
    buffer_km: float = 10.0,
    sector_degrees: float = 45.0,
    n_arc: int = 32,
) -> DataFrame:
    """Downwind sector of each centre ``(cx, cy)`` as an edge table: apex, ``n_arc`` points on
    the arc, apex again."""
    radius = buffer_km * 1000.0
    azimuth = F.pmod(F.col(wind).cast("double") + 180.0, F.lit(360.0))

    def at(i: Column) -> Column:
        bearing = azimuth - sector_degrees / 2.0 + i * (sector_degrees / (n_arc - 1))
        angle = F.radians(90.0 - bearing)
        return F.struct(
            (F.col("cx") + radius * F.cos(angle)).alias("x"),
            (F.col("cy") + radius * F.sin(angle)).alias("y"),
        )

    apex = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))
    ring = F.concat(
        F.array(apex), F.transform(F.sequence(F.lit(0), F.lit(n_arc - 1)), at), F.array(apex)
    )
    return (
        centers.select(key, ring.alias("_ring"))
        .select(key, "_ring", F.explode(F.sequence(F.lit(0), F.lit(n_arc))).alias("seq"))
        .select(
            key,
            F.lit(0).alias("part"),
            F.lit(0).alias("ring"),
            "seq",
            F.col("_ring")[F.col("seq")]["x"].alias("x1"),
            F.col("_ring")[F.col("seq")]["y"].alias("y1"),
            F.col("_ring")[F.col("seq") + 1]["x"].alias("x2"),
            F.col("_ring")[F.col("seq") + 1]["y"].alias("y2"),
        )
    )


def to_lon180(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    c = F.col(lon) if isinstance(lon, str) else lon
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def nearest_grid_points(
    points: DataFrame,
    lattice: DataFrame,
    k: int = 1,
    bucket_deg: float = 0.25,
    point_id: str = "point_id",
) -> DataFrame:
    """The ``k`` nearest lattice points of each point, distance in degrees, however far.

    Occupancy pyramid: the lattice is counted in cells of ``bucket_deg`` and of its doublings. The least level at which the
    nine cells around a point hold ``k`` lattice points bounds the distance of its k-th neighbour. Counts of cells four
    levels finer inside that bound tighten it, and only lattice points of finer cells within it are compared, so a far
    point meets few of them. No step is repeated. Points at the same place are searched once.
    """
    require_columns(points, [point_id, "lon", "lat"], "points")
    require_columns(lattice, ["gid", "lon", "lat"], "lattice")
    width = float(bucket_deg)
    cell = lambda c: F.floor(F.col(c) / width).cast("int")
    up = lambda c, by: F.expr(f"shiftright({c}, {by})")
    located = points.withColumn("_lon", to_lon180("lon"))
    grid = lattice.select("gid", to_lon180("lon").alias("glon"), F.col("lat").alias("glat")).distinct()
    grid = checkpoint(grid.withColumns({"fx": cell("glon"), "fy": cell("glat")}))
    total = grid.select("gid").distinct().limit(k).count()
    if total < k:
        raise ValueError(f"lattice has only {total} points, {k} wanted")
    # At the last level the nine cells hold the whole globe.
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(math.log2(720.0 / width))))))
    finest = checkpoint(grid.groupBy("fx", "fy").agg(F.count("*").alias("c")))
    occupied = finest.withColumn("level", levels).groupBy("level", up("fx", "level").alias("bx"), up("fy", "level").alias("by"))
    around = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    blocks = occupied.agg(F.sum("c").alias("c")).withColumn("_dx", around).withColumn("_dy", around)
    blocks = blocks.groupBy("level", (F.col("bx") + F.col("_dx")).alias("bx"), (F.col("by") + F.col("_dy")).alias("by"))
    blocks = blocks.agg(F.sum("c").alias("c")).where(F.col("c") >= k).select("level", "bx", "by")
    spots = located.select(F.col("_lon").alias("lon"), "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    spots = checkpoint(spots.distinct().withColumns({"sx": cell("lon"), "sy": cell("lat")}))
    homes = spots.select("sx", "sy").distinct().withColumn("level", levels)
    homes = homes.withColumns({"bx": up("sx", "level"), "by": up("sy", "level")}).join(broadcast_if_small(blocks), ["level", "bx", "by"])
    homes = homes.groupBy("sx", "sy").agg(F.min("level").alias("level"))
    placed = checkpoint(spots.join(homes, ["sx", "sy"]).withColumn("w", F.pow(F.lit(2.0), "level") * width))
    used = [r["level"] for r in placed.select("level").distinct().collect()] or [0]  # some of about fifteen levels

    def gap(x: str, i: str, w: str) -> Column:
        """Distance along an axis to a cell."""
        return F.greatest(F.col(i) * F.col(w) - F.col(x), F.col(x) - (F.col(i) + 1) * F.col(w), F.lit(0.0))

    def reach(x: str, i: str, w: str) -> Column:
        """Distance along an axis to a cell's far side."""
        return F.greatest((F.col(i) + 1) * F.col(w) - F.col(x), F.col(x) - F.col(i) * F.col(w))

    slack = 1.0 + 1e-12
    placed = placed.withColumns({"bx": up("sx", "level"), "by": up("sy", "level")})
    bound = F.hypot(reach("lon", "bx", "w") + F.col("w"), reach("lat", "by", "w") + F.col("w")) * slack
    placed = placed.withColumn("r", bound)
    span = lambda c: F.explode(F.sequence(
        F.floor((F.col(c) - F.col("r")) / F.col("w")).cast("int"), F.floor((F.col(c) + F.col("r")) / F.col("w")).cast("int")
    ))
    cells = placed.withColumn("px", span("lon")).withColumn("py", span("lat"))
    cells = cells.where(F.hypot(gap("lon", "px", "w"), gap("lat", "py", "w")) <= F.col("r")).select("lon", "lat", "level", "px", "py", "r")
    levelled = lambda df: df.withColumn("level", F.explode(F.array(*map(F.lit, used)))).withColumn(
        "m", F.greatest(F.col("level") - 4, F.lit(0))
    ).withColumns({"cx": up("fx", "m"), "cy": up("fy", "m")})
    fine = levelled(finest).groupBy("level", "m", "cx", "cy").agg(F.sum("c").alias("c"))
    fine = fine.withColumns({"px": up("cx", "level - m"), "py": up("cy", "level - m"), "wm": F.pow(F.lit(2.0), "m") * width})
    met = cells.join(broadcast_if_small(fine), ["level", "px", "py"]).withColumns({
        "_near": F.hypot(gap("lon", "cx", "wm"), gap("lat", "cy", "wm")), "_far": F.hypot(reach("lon", "cx", "wm"), reach("lat", "cy", "wm")),
    })
    spot = Window.partitionBy("lon", "lat")
    met = met.withColumn("_cum", F.sum("c").over(spot.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("_r", F.least("r", F.min(F.when(F.col("_cum") >= k, F.col("_far"))).over(spot)) * slack).where("_near <= _r")
    dealt = levelled(grid).select("level", "cx", "cy", "gid", "glon", "glat")
    distance = F.hypot(F.col("lon") - F.col("glon"), F.col("lat") - F.col("glat"))
    pairs = met.select("lon", "lat", "level", "cx", "cy", "_r").join(broadcast_if_small(dealt), ["level", "cx", "cy"])
    pairs = pairs.withColumn("distance_deg", distance).where(F.col("distance_deg") <= F.col("_r"))
    ranked = pairs.withColumn("rank", F.row_number().over(spot.orderBy("distance_deg", "gid"))).where(F.col("rank") <= k)
    hits = ranked.select(F.col("lon").alias("_hlon"), F.col("lat").alias("_hlat"), "gid", "distance_deg", "rank")
    return located.join(hits, (F.col("_lon") == F.col("_hlon")) & (located["lat"] == F.col("_hlat"))).select(
        points["*"], "gid", "distance_deg", "rank"
    )

"""Arrangements: edges cut where they meet, the winding number on both sides, and what is kept by a rule.

Repair, dissolve and offset are one computation on directed edges. Segments of a group are cut at every point
where they cross, touch or overlap; equal pieces are merged, their directions cancel. The winding number
beside a piece is the weight of all edges above its middle, which a tile knows from its own edges and from
its upper border (see ``planar``). A piece bounds the result if the rule tells its sides apart.

Vertices are snapped to a fine grid of ``precision``; a vertex within it of a segment lies on the segment.
Groups are independent, and every step joins on (group, tile) or on end points; no ring or polygon is ever
gathered in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns
from ..session import checkpoint
from .planar import COORDINATES, covered_borders, directed_areas, oriented, pieces_in_tiles, strips, weighted_edges

PRECISION = 1e-6
_ENDS = ("ax", "ay", "bx", "by")


def _inside(w: Column, rule: str) -> Column:
    """What counts as inside: an odd winding, a positive one, or any but 0."""
    if rule == "even_odd":
        return w % 2 != 0
    if rule == "positive":
        return w > 0
    if rule == "nonzero":
        return w != 0
    raise ValueError(f"unknown rule {rule!r}")


def segments(edges: DataFrame, keys: Sequence[str], precision: float = PRECISION) -> DataFrame:
    """Distinct segments (keys, ax, ay, bx, by, w) from the lesser end point to the greater; ``w`` is how
    often edges run along it less how often they run back. Segments that cancel go."""
    snap = lambda c: F.rint(F.col(c) / precision) * precision + F.lit(0.0)
    w = F.col("w") if "w" in edges.columns else F.lit(1).cast("long")
    e = edges.select(*keys, *(snap(c).alias(c) for c in COORDINATES), w.alias("_w"))
    forward = F.struct("x1", "y1") < F.struct("x2", "y2")
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    e = e.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).select(
        *keys, pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by"),
        F.when(forward, F.col("_w")).otherwise(-F.col("_w")).alias("_w"),
    )
    return e.groupBy(*keys, *_ENDS).agg(F.sum("_w").alias("w")).where("w != 0")


def _as_edges(s: DataFrame) -> DataFrame:
    return s.withColumns({"x1": F.col("ax"), "y1": F.col("ay"), "x2": F.col("bx"), "y2": F.col("by")})


def cut_points(s: DataFrame, keys: Sequence[str], tile: float, precision: float = PRECISION) -> DataFrame:
    """(keys, ax, ay, bx, by, px, py): inner points at which another segment of the group meets each segment."""
    keys = list(keys)
    slack = F.lit(float(precision))
    passed = pieces_in_tiles(_as_edges(s), tile, [*keys, *_ENDS])

    def beside(place: str, a: str, b: str) -> Column:
        """The tile, and the one beside it if the piece touches the border: segments may meet right there."""
        before, after = F.least(a, b) <= slack, F.greatest(a, b) >= F.lit(float(tile)) - slack
        return F.filter(F.array(F.col(place), F.when(before, F.col(place) - 1), F.when(after, F.col(place) + 1)), lambda p: p.isNotNull())

    here = passed.withColumn("row", F.explode(beside("row", "y1", "y2"))).withColumn("col", F.explode(beside("col", "x1", "x2")))
    here = here.select(*keys, "row", "col", *_ENDS).distinct()
    there = here.withColumnsRenamed({"ax": "cx", "ay": "cy", "bx": "dx", "by": "dy"})
    # Each pair once, so that both get the very same point.
    pairs = here.join(there, [*keys, "row", "col"]).where(F.struct("ax", "ay", "bx", "by") < F.struct("cx", "cy", "dx", "dy"))
    pairs = pairs.where(
        (F.col("cx") <= F.col("bx") + slack) & (F.least("ay", "by") <= F.greatest("cy", "dy") + slack)
        & (F.least("cy", "dy") <= F.greatest("ay", "by") + slack)
    )

    def touches(point: tuple[str, str], ends: tuple[str, str, str, str]) -> Column:
        """The end point lies on the inside of the segment."""
        (px, py), (ax, ay, bx, by) = map(F.col, point), map(F.col, ends)
        ux, uy, vx, vy = bx - ax, by - ay, px - ax, py - ay
        length = F.hypot(ux, uy)
        along = (ux * vx + uy * vy) / length
        near = F.abs(ux * vy - uy * vx) <= slack * length
        apart = ((px != ax) | (py != ay)) & ((px != bx) | (py != by))
        return near & (along > 0) & (along < length) & apart

    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    vx, vy = F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    gx, gy = F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")
    turn = ux * vy - uy * vx
    t, u = F.try_divide(gx * vy - gy * vx, turn), F.try_divide(gx * uy - gy * ux, turn)
    snap = lambda v: F.rint(v / precision) * precision + F.lit(0.0)
    cross = F.coalesce((t > 0) & (t < 1) & (u > 0) & (u < 1), F.lit(False))
    first, second = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")
    ends = {"_a": (("ax", "ay"), second), "_b": (("bx", "by"), second), "_c": (("cx", "cy"), first), "_d": (("dx", "dy"), first)}
    pairs = pairs.withColumns({name: touches(*of) for name, of in ends.items()})
    touch = F.col("_a") | F.col("_b") | F.col("_c") | F.col("_d")
    pairs = pairs.withColumn("_cross", cross & ~touch).where(F.col("_cross") | touch)
    px, py = snap(F.col("ax") + t * ux), snap(F.col("ay") + t * uy)

    def hit(cond: Column, of: tuple[str, ...], x: Column, y: Column) -> Column:
        names = [F.col(c).alias(n) for c, n in zip(of, _ENDS)]
        return F.when(cond, F.struct(*names, x.alias("px"), y.alias("py")))

    hits = [hit(F.col("_cross"), of, px, py) for of in (first, second)]
    hits += [hit(F.col(name), of, F.col(p[0]), F.col(p[1])) for name, (p, of) in ends.items()]
    found = pairs.select(*keys, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("_h")).select(*keys, "_h.*")
    a, b, p = F.struct("ax", "ay"), F.struct("bx", "by"), F.struct("px", "py")
    return found.where((p != a) & (p != b)).distinct()


def cut_segments(s: DataFrame, keys: Sequence[str], tile: float, precision: float = PRECISION) -> DataFrame:
    """The segments between all points where segments of a group meet, merged as by :func:`segments`."""
    keys = list(keys)
    points = cut_points(s, keys, tile, precision)
    inner = points.join(s, [*keys, *_ENDS])
    ends = s.select(*keys, *_ENDS, F.col("ax").alias("px"), F.col("ay").alias("py"), "w")
    along = Window.partitionBy(*keys, *_ENDS).orderBy(
        (F.col("px") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("py") - F.col("ay")) * (F.col("by") - F.col("ay"))
    )
    parts = ends.unionByName(inner).select(
        *keys, F.col("px").alias("x1"), F.col("py").alias("y1"),
        F.coalesce(F.lead("px").over(along), F.col("bx")).alias("x2"), F.coalesce(F.lead("py").over(along), F.col("by")).alias("y2"), "w",
    )
    return segments(parts, keys, precision)


def side_windings(s: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """Segments, none of which cross, with the winding number on their ``left`` and ``right``.

    The edges of a tile above a segment's middle are summed up; a segment that is straight up looks from
    just right of it.
    """
    keys, tile = list(keys), float(tile)
    name = F.xxhash64(*_ENDS)
    edges = _as_edges(s)
    own = strips(edges.withColumn("_name", name), tile, [*keys, "_name"])
    borders = covered_borders(edges, tile, keys).withColumn("_name", F.lit(0).cast("long"))
    above = own.unionByName(borders)
    above = above.withColumnsRenamed({c: f"_{c}" for c in (*COORDINATES, "w")})
    mx, my = (F.col("ax") + F.col("bx")) / 2.0, (F.col("ay") + F.col("by")) / 2.0
    middle = s.withColumns({"row": F.floor(my / tile), "col": F.floor(mx / tile), "_of": name})
    middle = middle.withColumns({"_mx": mx - F.col("col") * tile, "_my": my - F.col("row") * tile})
    height = F.col("_y1") + (F.col("_mx") - F.col("_x1")) / (F.col("_x2") - F.col("_x1")) * (F.col("_y2") - F.col("_y1"))
    counts = (F.col("_x1") <= F.col("_mx")) & (F.col("_mx") < F.col("_x2")) & (height > F.col("_my")) & (F.col("_name") != F.col("_of"))
    summed = middle.join(above, [*keys, "row", "col"], "left").groupBy(*keys, *_ENDS, "w").agg(
        F.coalesce(F.sum(F.when(counts, F.col("_w"))), F.lit(0)).alias("_sum")
    )
    upright = F.col("ax") == F.col("bx")
    left = F.when(upright, F.col("_sum") + F.col("w")).otherwise(F.col("_sum"))
    return summed.select(*keys, *_ENDS, left.alias("left"), (left - F.col("w")).alias("right"))


def bounded_region(edges: DataFrame, keys: Sequence[str], rule: str, tile: float, precision: float = PRECISION) -> DataFrame:
    """Directed edges (keys, x1, y1, x2, y2) of the region that ``rule`` takes as inside, on their left.

    ``edges`` are directed. The result's edges meet in end points only.
    """
    whole = checkpoint(segments(edges, keys, precision))
    cut = checkpoint(cut_segments(whole, keys, tile, precision))
    sides = side_windings(cut, keys, tile).withColumns({"_in": _inside(F.col("left"), rule), "_out": _inside(F.col("right"), rule)})
    sides = sides.where(F.col("_in") != F.col("_out"))
    pick = lambda a, b: F.when(F.col("_in"), F.col(a)).otherwise(F.col(b))
    return sides.select(
        *keys, pick("ax", "bx").alias("x1"), pick("ay", "by").alias("y1"), pick("bx", "ax").alias("x2"), pick("by", "ay").alias("y2")
    )


def make_valid(edges: DataFrame, tile: float, keys: Sequence[str] = ("feature_id",), precision: float = PRECISION) -> DataFrame:
    """Directed edges of repaired polygons: a point is inside if a ray from it crosses the rings oddly often.

    Bow-ties become two parts, overlaps of rings become holes, rings that are run through twice and spikes
    vanish, touching and nested rings come apart. Only ring edges are needed, in any order and direction.
    Features of which nothing is left are absent.
    """
    require_columns(edges, [*keys, *COORDINATES], "edges")
    return bounded_region(edges, keys, "even_odd", tile, precision)


def dissolve(
    edges: DataFrame, groups: DataFrame, tile: float, key: str = "feature_id", by: Sequence[str] = ("type",), precision: float = PRECISION
) -> DataFrame:
    """Directed edges of the union of each group's features. ``groups`` is (key, *by).

    Features are valid polygons as edge tables with parts and rings. Borders that two features share cancel.
    """
    directed = oriented(edges, [key]).select(key, *COORDINATES)
    return bounded_region(directed.join(groups.select(key, *by), key).drop(key), by, "positive", tile, precision)


def ring_walks(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Directed edges with ``ring_id`` and ``seq``, the place along the ring.

    The edge after a vertex is the first clockwise from the edge that came in, so parts that touch in a vertex come
    apart; a hole that touches its part in one vertex is walked with it. Rings are ranked by pointer
    doubling: in round k every edge knows the least edge of the 2^k next ones and how far it is. A ring ends
    when no edge learns of a lesser one. All edges are joined once a round; rounds are the logarithm of
    the longest ring.
    """
    keys = list(keys)
    e = edges.select(*keys, *COORDINATES, F.struct(*COORDINATES).alias("edge"))
    back = e.select(*keys, F.col("x2").alias("vx"), F.col("y2").alias("vy"), "edge", F.lit(1).alias("_in"),
                    F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("_angle"))
    on = e.select(*keys, F.col("x1").alias("vx"), F.col("y1").alias("vy"), "edge", F.lit(0).alias("_in"),
                  F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("_angle"))
    # Around a vertex, clockwise is by falling angle; past the least angle comes the greatest.
    turn = Window.partitionBy(*keys, "vx", "vy").orderBy(F.desc("_angle"), F.desc("_in"))
    out = F.when(F.col("_in") == 0, F.col("edge"))
    later, first = turn.rowsBetween(1, Window.unboundedFollowing), turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spokes = back.unionByName(on).withColumn(
        "next", F.coalesce(F.first(out, ignorenulls=True).over(later), F.first(out, ignorenulls=True).over(first))
    )
    state = spokes.where("_in = 1").select(*keys, "edge", "next", F.least("edge", "next").alias("least"),
                                           F.when(F.col("edge") <= F.col("next"), 0).otherwise(1).cast("long").alias("away"))
    state = checkpoint(state.withColumn("learned", F.lit(True)))
    step = 1
    while not state.where("learned").isEmpty():
        ahead = state.select(*keys, F.col("edge").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"), F.col("away").alias("_away"))
        lesser = F.col("_least") < F.col("least")
        state = checkpoint(state.join(ahead, [*keys, "next"]).select(
            *keys, "edge", F.col("_next").alias("next"), F.when(lesser, F.col("_least")).otherwise(F.col("least")).alias("least"),
            F.when(lesser, F.col("_away") + step).otherwise(F.col("away")).alias("away"), lesser.alias("learned"),
        ))
        step *= 2
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "least"))
    return state.withColumn("_n", size).select(
        *keys, F.xxhash64("least").alias("ring_id"), F.when(F.col("away") == 0, 0).otherwise(F.col("_n") - F.col("away")).alias("seq"), "edge.*"
    )


def polygon_rings(edges: DataFrame, tile: float, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Directed edges as polygons (keys, part, ring, seq, x1, y1, x2, y2): outer rings are ring 0 of their part,
    holes have the numbers above in the least outer ring around them. Parts are numbered by falling area."""
    keys = list(keys)
    walks = checkpoint(ring_walks(edges, keys))
    areas = checkpoint(directed_areas(walks, [*keys, "ring_id"]))
    outer, holes = areas.where("area_m2 > 0"), areas.where("area_m2 < 0")
    tile = float(tile)
    # A hole lies where the middle of its first edge lies.
    at = walks.where("seq = 0").join(holes.select(*keys, "ring_id"), [*keys, "ring_id"]).select(
        *keys, F.col("ring_id").alias("hole"), ((F.col("x1") + F.col("x2")) / 2.0).alias("_px"), ((F.col("y1") + F.col("y2")) / 2.0).alias("_py")
    )
    at = at.withColumns({"row": F.floor(F.col("_py") / tile), "col": F.floor(F.col("_px") / tile)})
    at = at.withColumns({"_px": F.col("_px") - F.col("col") * tile, "_py": F.col("_py") - F.col("row") * tile})
    around = weighted_edges(walks.join(outer.select(*keys, "ring_id"), [*keys, "ring_id"]), tile, [*keys, "ring_id"])
    height = F.col("y1") + (F.col("_px") - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    above = (F.col("x1") <= F.col("_px")) & (F.col("_px") < F.col("x2")) & (height > F.col("_py"))
    inside = at.join(around, [*keys, "row", "col"]).where(above).groupBy(*keys, "hole", "ring_id").agg(F.sum("w").alias("w")).where("w > 0")
    owner = inside.join(outer, [*keys, "ring_id"]).groupBy(*keys, "hole").agg(F.min_by("ring_id", F.struct("area_m2", "ring_id")).alias("_outer"))
    by_size = Window.partitionBy(*keys).orderBy(F.desc("area_m2"), "ring_id")
    parts = outer.withColumn("part", F.row_number().over(by_size) - 1).select(*keys, F.col("ring_id").alias("_outer"), "part")
    of_hole = owner.join(parts, [*keys, "_outer"]).join(areas.withColumnRenamed("ring_id", "hole"), [*keys, "hole"])
    in_part = Window.partitionBy(*keys, "part").orderBy("area_m2", "hole")
    rings = parts.select(*keys, F.col("_outer").alias("ring_id"), "part", F.lit(0).alias("ring")).unionByName(
        of_hole.select(*keys, F.col("hole").alias("ring_id"), "part", F.row_number().over(in_part).alias("ring"))
    )
    return walks.join(rings, [*keys, "ring_id"]).select(*keys, "part", "ring", "seq", *COORDINATES)

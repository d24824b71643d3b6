"""Polygons grown or shrunk by a distance.

Every edge is moved along its normal, to the inside for a shrink; at corners that open the moved edges are joined by
an arc around the corner, at corners that close by a detour over the corner itself. The raw curve winds
around the result once; what it turns over is wound around in the other direction or not at all, so
the arrangement of the curve with the rule ``positive`` is the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrangement import PRECISION, bounded_region
from .planar import COORDINATES, oriented


def raw_offset(edges: DataFrame, distance_m: float, keys: Sequence[str] = ("feature_id",), quad_segs: int = 16) -> DataFrame:
    """Directed edges of the raw curve; ``distance_m`` is positive to the outside."""
    inward = -float(distance_m)
    ring = [*keys, "part", "ring"]
    real = oriented(edges, keys).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    e = real.withColumns({"_ux": (F.col("x2") - F.col("x1")) / length, "_uy": (F.col("y2") - F.col("y1")) / length})
    along = Window.partitionBy(*ring).orderBy("seq")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumns({f"_v{c}": F.coalesce(F.lead(f"_u{c}").over(along), F.first(f"_u{c}").over(whole)) for c in "xy"})
    ux, uy, vx, vy = map(F.col, ("_ux", "_uy", "_vx", "_vy"))
    turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    e = e.withColumn("_turn", turn)
    # Normals point to the left, which is inside.
    point = lambda x, y, nx, ny: F.struct(
        (F.col(x) + nx * inward).alias("x"), (F.col(y) + ny * inward).alias("y")
    )
    n = F.greatest(F.ceil(F.abs("_turn") / (pi / 2 / quad_segs) - 1e-9), F.lit(1)).cast("int")
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def on_arc(k):
        angle = F.col("_turn") * k / n
        cos, sin = F.cos(angle), F.sin(angle)
        return point("x2", "y2", -uy * cos - ux * sin, -uy * sin + ux * cos)

    opens = (F.col("_turn") * inward < 0) & (F.abs("_turn") > 1e-12)
    corner = F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    join = F.when(opens, F.transform(steps, on_arc)).when(F.abs("_turn") > 1e-12, corner).otherwise(F.slice(corner, 1, 0))
    path = F.concat(F.array(point("x1", "y1", -uy, ux), point("x2", "y2", -uy, ux)), join, F.array(point("x2", "y2", -vy, vx)))
    pairs = F.arrays_zip(F.slice(path, 1, F.size(path) - 1).alias("a"), F.slice(path, 2, F.size(path) - 1).alias("b"))
    return e.select(*keys, F.explode(pairs).alias("_p")).select(
        *keys, F.col("_p.a.x").alias("x1"), F.col("_p.a.y").alias("y1"), F.col("_p.b.x").alias("x2"), F.col("_p.b.y").alias("y2")
    )


def offset_polygons(
    edges: DataFrame, distance_m: float, tile: float, keys: Sequence[str] = ("feature_id",), quad_segs: int = 16, precision: float = PRECISION
) -> DataFrame:
    """Directed edges (keys, x1, y1, x2, y2) of valid polygons grown by ``distance_m``, or shrunk if it is negative.

    Round corners are drawn with ``quad_segs`` chords a quarter. Polygons that vanish are absent; parts that
    grow together are one.
    """
    if distance_m == 0:
        return oriented(edges, keys).select(*keys, *COORDINATES)
    return bounded_region(raw_offset(edges, distance_m, keys, quad_segs), keys, "positive", tile, precision)

"""Measures and keys of features stored as edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns

# Square metres → acres, one constant per report (they differ in the fifth digit).
ACRES_PER_M2 = 0.000247105
M2_PER_ACRE_SPREAD = 4046.86
M2_PER_ACRE_UNITS = 4046.856


def _cross() -> Column:
    return F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")


def ring_areas(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Signed shoelace area and first moments per ring."""
    return edges.groupBy(*keys, "part", "ring").agg(
        (F.sum(_cross()) / 2.0).alias("signed"),
        F.sum((F.col("x1") + F.col("x2")) * _cross()).alias("mx"),
        F.sum((F.col("y1") + F.col("y2")) * _cross()).alias("my"),
        F.count("*").alias("n_edges"),
    )


def _ring_sign() -> Column:
    """Outer rings (ring 0) add, holes subtract, whatever their winding."""
    return F.when(F.col("ring") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def polygon_areas(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Area in square metres per feature."""
    return (
        ring_areas(edges, keys)
        .groupBy(*keys)
        .agg(F.sum(_ring_sign() * F.abs("signed")).alias("area_m2"))
    )


def acres(area_m2: Column | str, constant: str = "treatments") -> Column:
    """Square metres → acres with the constant of the given report: ``treatments``, ``spread``
    or ``units`` (the last one rounds to 2 digits)."""
    a = F.col(area_m2) if isinstance(area_m2, str) else area_m2
    if constant == "treatments":
        return a * ACRES_PER_M2
    if constant == "spread":
        return a / M2_PER_ACRE_SPREAD
    if constant == "units":
        return F.bround(a / M2_PER_ACRE_UNITS, 2)
    raise ValueError(f"unknown acre constant {constant!r}")


def unit_acres(areas: DataFrame) -> DataFrame:
    """Acres per unit. ``areas`` is ``(unit_name, unit_id, area_m2)``; layers without ids
    (``unit_id`` NULL) are summed into one unit named after the layer."""
    return (
        areas.groupBy("unit_name", F.coalesce("unit_id", "unit_name").alias("unit_id"))
        .agg(F.sum("area_m2").alias("_m2"))
        .select("unit_name", "unit_id", acres("_m2", "units").alias("unit_acres"))
    )


def centroids(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Area-weighted centroid per feature; holes count negatively."""
    orient = F.when(F.col("signed") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * _ring_sign()
    sums = (
        ring_areas(edges, keys)
        .groupBy(*keys)
        .agg(
            F.sum(orient * F.col("signed")).alias("_a"),
            F.sum(orient * F.col("mx")).alias("_mx"),
            F.sum(orient * F.col("my")).alias("_my"),
        )
    )
    return sums.where(F.col("_a") != 0).select(
        *keys,
        (F.col("_mx") / (6.0 * F.col("_a"))).alias("cx"),
        (F.col("_my") / (6.0 * F.col("_a"))).alias("cy"),
    )


def bounding_boxes(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    aggs = [
        F.min(F.least("x1", "x2")).alias("minx"),
        F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"),
        F.max(F.greatest("y1", "y2")).alias("maxy"),
    ]
    return edges.groupBy(*keys).agg(*aggs) if keys else edges.agg(*aggs)


def intersecting_box(
    boxes: DataFrame,
    bounds: tuple[float, float, float, float],
    state_fips: str | int | Sequence[str | int] | None = None,
) -> DataFrame:
    """Features whose bounding box meets ``bounds`` (minx, miny, maxx, maxy), optionally of some
    states (codes are zero-padded to two digits)."""
    minx, miny, maxx, maxy = (float(b) for b in bounds)
    out = boxes.where(
        (F.col("maxx") >= minx)
        & (F.col("minx") <= maxx)
        & (F.col("maxy") >= miny)
        & (F.col("miny") <= maxy)
    )
    if state_fips is not None:
        codes = [state_fips] if isinstance(state_fips, (str, int)) else list(state_fips)
        out = out.where(F.col("statefp").isin([str(c).zfill(2) for c in codes]))
    return out


def valid_rings(edges: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Edges of the usable polygon rings: closed, at least three edges, non-zero area.

    A ring is closed when every vertex is left as often as it is entered; the test compares sums
    over starts and ends, so no ring is gathered in order.
    """
    point = lambda x, y: F.xxhash64(x, y).cast("decimal(38,0)")
    ring = [*keys, "part", "ring"]
    good = (
        edges.groupBy(*ring)
        .agg(
            F.count("*").alias("_n"),
            F.abs(F.sum(_cross())).alias("_a2"),
            F.sum(point("x1", "y1")).alias("_starts"),
            F.sum(point("x2", "y2")).alias("_ends"),
        )
        .where((F.col("_n") >= 3) & (F.col("_a2") > 0) & (F.col("_starts") == F.col("_ends")))
        .select(*ring)
    )
    return edges.join(good, ring, "left_semi")


def geometry_keys(
    edges: DataFrame, keys: Sequence[str] = ("feature_id",), grid: float = 0.01
) -> DataFrame:
    """Equality key of a geometry on a coarse grid, independent of vertex order, start point,
    direction and part numbering. Features that collapse to nothing get NULL.

    The key is a digest over the multiset of undirected snapped edges, so it is a plain
    distributed aggregate.
    """
    snap = lambda c: F.rint(F.col(c) / grid).cast("bigint")
    snapped = edges.select(
        *keys,
        F.struct(snap("x1").alias("x"), snap("y1").alias("y")).alias("a"),
        F.struct(snap("x2").alias("x"), snap("y2").alias("y")).alias("b"),
    )
    ends = F.array_sort(F.array("a", "b"))
    text = F.concat_ws(
        " ", ends[0]["x"].cast("string"), ends[0]["y"].cast("string"),
        ends[1]["x"].cast("string"), ends[1]["y"].cast("string"),
    )
    digest = F.md5(text.cast("binary"))
    piece = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast(
        "decimal(38,0)"
    )
    real = F.col("a") != F.col("b")
    sums = snapped.groupBy(*keys).agg(
        F.count_if(real).alias("_n"),
        F.sum(F.when(real, piece(1))).alias("_h1"),
        F.sum(F.when(real, piece(16))).alias("_h2"),
    )
    key = F.md5(
        F.concat_ws(
            "-", F.col("_n").cast("string"), F.col("_h1").cast("string"),
            F.col("_h2").cast("string"),
        ).cast("binary")
    )
    return sums.select(*keys, F.when(F.col("_n") > 0, key).alias("geom_key"))


def drop_duplicate_geometries(
    edges: DataFrame, key: str = "feature_id", grid: float = 0.01
) -> DataFrame:
    """Feature ids with one representative (the smallest id) per distinct geometry."""
    return (
        geometry_keys(edges, [key], grid)
        .where(F.col("geom_key").isNotNull())
        .groupBy("geom_key")
        .agg(F.min(key).alias(key), F.count("*").alias("n_copies"))
    )


def normalise_roads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw line features → road table and trail table.

    List-valued tags keep their first element, unknown types are dropped, duplicates by
    (element, osmid) keep the first chunk's record; tracks are both road and trail.
    """
    from ..functions.names import HIGHWAY_CODES, TRAIL_TYPES, flatten_tag, highway_code

    require_columns(raw, ["element", "osmid", "highway", "chunk"], "raw lines")
    first = Window.partitionBy("element", "osmid").orderBy("chunk")
    tagged = (
        raw.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .drop("_rank")
        .withColumn("highway", flatten_tag("highway"))
    )
    known = [*HIGHWAY_CODES, *[t for t in TRAIL_TYPES if t not in HIGHWAY_CODES]]
    tagged = tagged.where(F.col("highway").isin(known))
    roads = tagged.where(F.col("highway").isin(list(HIGHWAY_CODES))).withColumn(
        "highway_code", highway_code("highway")
    )
    return roads, tagged.where(F.col("highway").isin(list(TRAIL_TYPES)))

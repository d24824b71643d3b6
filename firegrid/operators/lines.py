"""Line operators: splitting by length, overlap attributes, elimination of small zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Grid, require_columns
from ..session import checkpoint
from .geometry import ACRES_PER_M2
from .rasterize import grid_edges

CHUNK = 4096


def running_length(
    edges: DataFrame, keys: Sequence[str] = ("feature_id",), chunk: int = CHUNK
) -> DataFrame:
    """Add ``length``, ``start`` and ``end`` (distance along the line, in ``seq`` order).

    Two-level prefix sum: segments are cut into chunks of ``seq``; the totals of the chunks are
    accumulated first, so one very long line is spread over many tasks.
    """
    keys = list(keys)
    require_columns(edges, [*keys, "seq", "x1", "y1", "x2", "y2"], "edges")
    e = edges.withColumns(
        {
            "length": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")),
            "_chunk": F.floor(F.col("seq") / chunk),
        }
    )
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    totals = (
        e.groupBy(*keys, "_chunk")
        .agg(F.sum("length").alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(over_chunks) - F.col("_sum"))
        .select(*keys, "_chunk", "_before")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("seq")
    return (
        e.join(totals, [*keys, "_chunk"])
        .withColumn("end", F.col("_before") + F.sum("length").over(inside))
        .withColumn("start", F.col("end") - F.col("length"))
        .drop("_chunk", "_before")
    )


def split_lines(
    edges: DataFrame, every_m: float = 2000.0, keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """Cut lines at multiples of ``every_m`` along their length. Returns the pieces' edges with
    ``segment`` (0, 1, … per line) and their length."""
    keys = list(keys)
    measured = running_length(edges, keys).where(F.col("length") > 0)
    first = F.floor(F.col("start") / every_m).cast("bigint")
    last = F.greatest(first, F.ceil(F.col("end") / every_m).cast("bigint") - 1)
    cut = measured.withColumn("segment", F.explode(F.sequence(first, last))).withColumns(
        {
            "_s": F.greatest(F.col("start"), F.col("segment") * every_m),
            "_e": F.least(F.col("end"), (F.col("segment") + 1) * every_m),
        }
    ).where(F.col("_e") > F.col("_s"))
    t0 = (F.col("_s") - F.col("start")) / F.col("length")
    t1 = (F.col("_e") - F.col("start")) / F.col("length")
    along = lambda a, b, t: F.col(a) + t * (F.col(b) - F.col(a))
    return cut.select(
        *keys, "segment", "seq",
        along("x1", "x2", t0).alias("x1"), along("y1", "y2", t0).alias("y1"),
        along("x1", "x2", t1).alias("x2"), along("y1", "y2", t1).alias("y2"),
        (F.col("_e") - F.col("_s")).alias("length"),
    )


def line_cell_lengths(
    edges: DataFrame, grid: Grid, keys: Sequence[str] = ("feature_id",)
) -> DataFrame:
    """Length of each line inside each cell it passes (metres)."""
    keys = list(keys)
    e = grid_edges(edges, grid, keys)

    def cuts(a: str, b: str):
        low, high = F.ceil(F.least(a, b)).cast("int"), F.floor(F.greatest(a, b)).cast("int")
        steps = F.when((low <= high) & (F.col(a) != F.col(b)), F.sequence(low, high)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(steps, lambda g: (g - F.col(a)) / (F.col(b) - F.col(a)))

    ts = F.array_sort(
        F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts("ax", "bx"), cuts("ay", "by")))
    )
    pieces = (
        e.withColumn("_t", ts)
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_t") - 1)))
        .withColumns({"_t0": F.get("_t", F.col("_i") - 1), "_t1": F.get("_t", F.col("_i"))})
    )
    mid = (F.col("_t0") + F.col("_t1")) / 2.0
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    return (
        pieces.select(
            *keys,
            F.floor(F.col("ay") + mid * (F.col("by") - F.col("ay"))).cast("int").alias("row"),
            F.floor(F.col("ax") + mid * (F.col("bx") - F.col("ax"))).cast("int").alias("col"),
            ((F.col("_t1") - F.col("_t0")) * size * float(grid.cell)).alias("length_m"),
        )
        .where(F.col("length_m") > 0)
        .groupBy(*keys, "row", "col")
        .agg(F.sum("length_m").alias("length_m"))
    )


def largest_overlap_join(
    segments: DataFrame,
    segment_edges: DataFrame,
    zone_cells: DataFrame,
    zones: DataFrame,
    grid: Grid,
    key: str = "segment_id",
    zone: str = "zone_id",
) -> DataFrame:
    """Attributes of the zone holding the longest part of each segment (left join)."""
    lengths = line_cell_lengths(segment_edges, grid, [key])
    best = (
        lengths.join(zone_cells.select(zone, "row", "col"), ["row", "col"])
        .groupBy(key, zone)
        .agg(F.sum("length_m").alias("_len"))
        .groupBy(key)
        .agg(
            F.min_by(zone, F.struct(-F.round("_len", 6), F.col(zone))).alias(zone),
            F.max("_len").alias("overlap_m"),
        )
    )
    return segments.join(best, key, "left").join(zones, zone, "left")


def regroup(df: DataFrame, attributes: Sequence[str], ids: str = "segment_id") -> DataFrame:
    """Dissolve by attributes: one row per attribute combination with its member count."""
    return df.groupBy(*attributes).agg(
        F.count(ids).alias("n_segments"), F.min(ids).alias("first_segment")
    )


def zone_neighbours(zone_cells: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Pairs ``(a, b)`` of zones sharing a cell side, in both directions."""
    looks = F.explode(
        F.array(
            F.struct(F.col("row").alias("row"), (F.col("col") + 1).alias("col")),
            F.struct((F.col("row") + 1).alias("row"), F.col("col").alias("col")),
        )
    )
    here = zone_cells.select(F.col(zone).alias("a"), looks.alias("_at")).select(
        "a", "_at.row", "_at.col"
    )
    pairs = (
        here.join(zone_cells.select("row", "col", F.col(zone).alias("b")), ["row", "col"])
        .where(F.col("a") != F.col("b"))
        .select("a", "b")
        .distinct()
    )
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _merge_targets(pairs: DataFrame, sizes: DataFrame, min_acres: float) -> DataFrame:
    """Moves ``(a, b)``: each small zone to its largest neighbour, as far as that neighbour is
    larger in (acres, id); this order keeps moves free of cycles."""
    rank = lambda p: F.struct(F.col(f"acres_{p}"), F.col(p))
    size_of = lambda p: sizes.select(F.col("z").alias(p), F.col("acres").alias(f"acres_{p}"))
    return (
        pairs.join(size_of("a").where(F.col("acres_a") < min_acres), "a")
        .join(size_of("b"), "b")
        .groupBy("a", "acres_a")
        .agg(F.max(rank("b")).alias("t"))
        .where((F.col("t.acres_b") > F.col("acres_a"))
               | ((F.col("t.acres_b") == F.col("acres_a")) & (F.col("t.b") > F.col("a"))))
        .select("a", F.col("t.b").alias("b"))
    )


def _follow(moves: DataFrame) -> DataFrame:
    """Replace each target by the end of its chain of moves (pointer doubling)."""
    while True:
        hop = moves.select(F.col("a").alias("b"), F.col("b").alias("_next"))
        longer = checkpoint(
            moves.join(hop, "b", "left").select(
                "a", F.coalesce("_next", "b").alias("b"), F.col("_next").isNotNull().alias("_hop")
            )
        )
        moves = longer.select("a", "b")
        if longer.where("_hop").isEmpty():
            return moves


def eliminate_small_zones(
    zone_cells: DataFrame, grid: Grid, min_acres: float = 70.0, zone: str = "zone_id"
) -> DataFrame:
    """Merge zones smaller than ``min_acres`` into their largest neighbour until every zone that
    has a neighbour is large enough. Cells without a zone are dropped.

    The rounds run on the zone graph (sizes and neighbour pairs); cells are relabelled once at the
    end. Only the answer to "is there another move" reaches the driver.
    """
    per_cell = grid.cell * grid.cell * ACRES_PER_M2
    cells = zone_cells.where(F.col(zone).isNotNull())
    labels = checkpoint(
        cells.groupBy(zone).agg((F.count("*") * per_cell).alias("acres"))
        .select(F.col(zone).alias("z0"), F.col(zone).alias("z"), "acres")
    )
    pairs = checkpoint(zone_neighbours(cells, zone))
    while True:
        sizes = labels.groupBy("z").agg(F.sum("acres").alias("acres"))
        moves = checkpoint(_merge_targets(pairs, sizes, min_acres))
        if moves.isEmpty():
            break
        moves = _follow(moves)
        renamed = lambda p: moves.select(F.col("a").alias(p), F.col("b").alias(f"_{p}"))
        labels = checkpoint(
            labels.join(renamed("z"), "z", "left").select("z0", F.coalesce("_z", "z").alias("z"), "acres")
        )
        pairs = checkpoint(
            pairs.join(renamed("a"), "a", "left")
            .join(renamed("b"), "b", "left")
            .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
    final = labels.select(F.col("z0").alias(zone), F.col("z").alias("_z"))
    return cells.join(final, zone).drop(zone).withColumnRenamed("_z", zone)

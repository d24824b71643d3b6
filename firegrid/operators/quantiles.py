"""Exact grouped quantiles by rank selection, which never gathers a whole group in one task.

One scan counts the values of every group, measure and size class together; the classes follow each other in
the order of the values, so the running counts tell which of them holds a wanted rank. Counts are made on the
map side and their number is bounded by the classes. A rank whose class holds one value only is found. The
others' classes are the brackets of the next scan, which counts inside them by finer classes, or value by
value once few rows are left. Nothing is stored but counts, and one way serves groups of every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint

# Equal parts a bracket is cut into when too many rows are left in it.
STEPS = 4096
# Size classes per doubling of the value.
CLASSES = 256
# Rows inside brackets up to which their values are counted one by one.
MOST_ROWS = 20_000_000


def _size_class(v: Column) -> Column:
    """A number that never falls as ``v`` grows."""
    size = F.greatest(F.least(F.floor(F.log2(F.abs(v)) * CLASSES), F.lit(10.0**6)), F.lit(-(10.0**6))).cast("int") + 2_000_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def _narrowed(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """The class that holds each wanted rank: its least and largest value, and the rows before and inside. ``counts`` are
    classes in the order of ``bucket``, for every rank (the last of ``key``)."""
    along = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ended = counts.withColumn("_end", F.col("below") + F.sum("m").over(along))
    holds = (F.col("rank") >= F.col("_end") - F.col("m")) & (F.col("rank") < F.col("_end"))
    return ended.where(holds).select(*key, "n", "lo", "hi", (F.col("_end") - F.col("m")).alias("below"), "m")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column | str],
    probs: Sequence[float] = (0.5,),
    steps: int = STEPS,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles of each measure per group, NULLs ignored.

    Returns ``keys``, ``measure``, ``n`` (non-NULL rows) and ``q`` (one value per probability).
    Groups without any value are absent. ``df`` is read once for the classes, and once more for each round
    of brackets; with at most ``most_rows`` rows in brackets that is one round. ``steps`` and ``most_rows``
    change cost only.
    """
    keys = list(keys)
    group = [*keys, "measure"]
    key = [*group, "rank"]
    values = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("measure"),
                    (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"),
                )
                for name, c in measures.items()
            ]
        )
    )
    rows = (
        df.select(*keys, values.alias("_m"))
        .select(*keys, "_m.measure", "_m.v")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
    )
    tally = (F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    classes = rows.groupBy(*group, _size_class(F.col("v")).alias("bucket")).agg(*tally)
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    around = F.array(*[f(place(p)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    first = (
        classes.withColumn("n", F.sum("m").over(Window.partitionBy(*group)))
        .withColumn("rank", F.explode(F.array_distinct(around)))
        .withColumn("below", F.lit(0).cast("long"))
    )
    state = checkpoint(_narrowed(first, key))
    while True:
        waiting = state.where("lo < hi")
        left = waiting.agg(F.sum("m").alias("m")).first()["m"]
        if left is None:
            break
        names = [f"_g{j}" for j in range(len(group))]
        side = waiting.select(
            *[F.col(c).alias(g) for c, g in zip(group, names)],
            F.struct("rank", "n", "below", F.col("lo").alias("_from"), F.col("hi").alias("_to")).alias("_b"),
        ).groupBy(*names).agg(F.collect_list("_b").alias("_bs"))  # as many as ranks
        on = F.lit(True)
        for c, g in zip(group, names):
            on = on & F.col(c).eqNullSafe(F.col(g))
        met = F.filter("_bs", lambda b: (F.col("v") >= b["_from"]) & (F.col("v") <= b["_to"]))
        inside = rows.join(broadcast_if_small(side), on).select(*group, "v", F.explode(met).alias("_b")).select(*group, "v", "_b.*")
        # The ends of a bracket differ and fall into different parts, so brackets shrink.
        share = F.try_divide(F.col("v") / 2 - F.col("_from") / 2, F.col("_to") / 2 - F.col("_from") / 2)
        part = F.when(F.col("v") == F.col("_from"), 0).when(F.col("v") == F.col("_to"), steps).otherwise(F.floor(share * steps))
        bucket = F.col("v") if left <= most_rows else part.cast("double")
        counts = inside.groupBy(*key, "n", "below", bucket.alias("bucket")).agg(*tally)
        state = checkpoint(state.where("lo = hi").unionByName(_narrowed(counts, key)))
    found = state.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_at"))

    def value(p: float) -> Column:
        low, high = (F.try_element_at("_at", f(place(p)).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return found.select(*group, "n", F.array(*map(value, probs)).alias("q"))


def medians(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column | str]
) -> DataFrame:
    """One row per group with the exact median of every measure under the measure's name."""
    return quantile_columns(df, keys, {name: (c, name, 0.5) for name, c in measures.items()})


def quantile_columns(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column | str, str, float]]
) -> DataFrame:
    """Wide form: output column → (value, measure name, probability)."""
    probs = sorted({p for _, _, p in wanted.values()})
    sources = {measure: c for c, measure, _ in wanted.values()}
    rows = exact_quantiles(df, keys, sources, probs)
    aggs = [
        F.max(
            F.when(F.col("measure") == measure, F.element_at("q", probs.index(p) + 1))
        ).alias(out)
        for out, (_, measure, p) in wanted.items()
    ]
    return rows.groupBy(*keys).agg(*aggs)

"""Zonal statistics: pixels that already carry their zone → one row per zone (and class)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns

STATS = {
    "mean": F.avg,
    "sum": F.sum,
    "count": F.count,
    "std": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}


def zonal_categorical(
    zoned: DataFrame,
    value: Column | str,
    zone: Sequence[str] = ("feature_id",),
    name: str = "class_val",
    nodata_in_denominator: bool = False,
) -> DataFrame:
    """Pixel count and percent cover per zone and class.

    NULL classes are nodata: they give no row and do not count in the total, unless
    ``nodata_in_denominator`` keeps them in the total. Zones without valid pixels are absent.
    The window runs over the few class rows of each zone, after the partial aggregation.
    """
    v = F.col(value) if isinstance(value, str) else value
    zone = list(zone)
    counted = zoned.withColumn(name, v)
    if not nodata_in_denominator:
        counted = counted.where(F.col(name).isNotNull())
    counts = counted.groupBy(*zone, name).agg(F.count("*").alias("pixel_count"))
    total = F.sum("pixel_count").over(Window.partitionBy(*zone))
    return counts.withColumn("pct_cover", F.col("pixel_count") / total * 100.0).where(
        F.col(name).isNotNull()
    )


def zonal_continuous(
    zoned: DataFrame,
    value: Column | str,
    stats: Sequence[str] = ("mean",),
    zone: Sequence[str] = ("feature_id",),
    nodata: float | None = None,
    scale_factor: float = 1.0,
    prefix: str = "",
) -> DataFrame:
    """Statistics per zone. Nodata is compared before scaling; zones without valid values are
    absent, also for ``count``. ``std`` is the population standard deviation."""
    unknown = [s for s in stats if s not in STATS]
    if unknown:
        raise ValueError(f"stat must be one of {list(STATS)}; got {unknown}")
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    valid = v.isNotNull() & ~F.isnan(v)
    if nodata is not None:
        valid = valid & (v != float(nodata))
    # Aggregates skip NULLs, so nothing is filtered below the aggregation: a filter would be
    # pushed into the scan side and evaluate a computed ``value`` twice.
    return (
        zoned.withColumn("_v", F.when(valid, v / float(scale_factor)))
        .groupBy(*zone)
        .agg(*[STATS[s]("_v").alias(f"{prefix}{s}") for s in stats], F.count("_v").alias("_valid"))
        .where(F.col("_valid") > 0)
        .drop("_valid")
    )


def band_stats(
    zoned: DataFrame,
    value: Column | str,
    attr: str = "value",
    stats: Sequence[str] | None = None,
    ztype: str = "categorical",
    zone: Sequence[str] = ("feature_id",),
) -> DataFrame:
    """Statistics of one band under the all-touched rule; ``zoned`` comes from
    :func:`touched_spans`, so overlapping zones each count their own pixels.

    Categorical: ``attr``, ``attr_count``, ``attr_pct_cover``. Continuous: ``attr_<stat>``.
    """
    if ztype == "categorical":
        return zonal_categorical(zoned, value, zone, name=attr).withColumnsRenamed(
            {"pixel_count": f"{attr}_count", "pct_cover": f"{attr}_pct_cover"}
        )
    if ztype != "continuous":
        raise ValueError("ztype must be 'categorical' or 'continuous'")
    if not stats:
        raise ValueError("continuous mode needs a list of statistics")
    return zonal_continuous(zoned, value, stats, zone, prefix=f"{attr}_")


def zone_clip_area(zoned: DataFrame, value: str, cell: float,
                   zone: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Acres of the valid baseline pixels of each zone."""
    require_columns(zoned, [value, *zone], "zoned pixels")
    return zoned.groupBy(*zone).agg(
        F.bround(F.count(value) * (cell * cell) / 4046.86, 2).alias("acres_gis")
    )

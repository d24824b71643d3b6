"""Everything a probability run needs to know about the weather of a region, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.climatology import current_erc, erc_classes, erc_stats, season_erc, season_matrix
from ..operators.windrose import region_wind_roses, wind_rose_documents
from ..session import checkpoint

CLASS_FIELDS = (
    "class", "lower", "upper", "fm1", "fm10", "fm100", "fm_herb", "fm_woody", "spot_dist",
    "spot_prob", "spot2",
)


def weather_bundle(
    wx: DataFrame,
    obs: DataFrame,
    current_start: int = 91,
    current_days: int = 79,
    region: str = "pyrome",
    obs_region: str = "pyrome_id",
    classes: DataFrame | None = None,
) -> DataFrame:
    """One row per region having both climatology and wind: wind table and calm share, historic
    ERC matrix, mean and deviation, ERC classes, current-season ERC. Every list is bounded by
    years x 214 values."""
    season = checkpoint(season_erc(wx, region))  # read three times below

    def by_day(c: str):
        pairs = F.array_sort(F.collect_list(F.struct("dos", c)))
        return F.transform(pairs, lambda s: s.getField(c)).alias(c)

    stats = erc_stats(season, region).groupBy(region).agg(by_day("erc_avg"), by_day("erc_std"))
    now = (
        current_erc(season, current_start, current_days, region)
        .groupBy(region)
        .agg(by_day("erc"))
        .withColumnRenamed("erc", "current_erc")
    )
    table = classes if classes is not None else erc_classes(wx, region)
    class_rows = table.groupBy(region).agg(
        F.array_sort(F.collect_list(F.struct(*CLASS_FIELDS))).alias("erc_classes")
    )
    wind = wind_rose_documents(region_wind_roses(obs, obs_region), obs_region).select(
        F.col(obs_region).alias(region), F.col("WindCellValues").alias("wind_cells"),
        F.col("CalmValue").alias("calm_value"), "n_observations",
    )
    return (
        season_matrix(season, region)
        .withColumnRenamed("erc", "erc_historic")
        .join(stats, region)
        .join(now, region)
        .join(class_rows, region)
        .join(wind, region)
    )

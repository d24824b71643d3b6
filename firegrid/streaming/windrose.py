"""Wind-rose counts kept up to date over a stream of observations.

The stream aggregates into (region, day, speed bin, direction bin) counts; the state is bounded by
the watermark. :func:`rose_from_counts` turns the accumulated counts into the same table as the
batch operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wind import (
    CALM_THRESHOLD_MPH, DIR_BREAKS_DEG, SPEED_BREAKS_MPH, known_direction_bin, speed_bin,
)
from ..schema import require_columns


def stream_bin_counts(
    obs: DataFrame,
    region: str = "pyrome_id",
    time: str = "ts",
    delay: str = "2 days",
    speed_breaks: Sequence[float] = SPEED_BREAKS_MPH,
    dir_breaks: Sequence[float] = DIR_BREAKS_DEG,
    calm: float = CALM_THRESHOLD_MPH,
) -> DataFrame:
    """Daily bin counts per region; calm observations have NULL bins."""
    require_columns(obs, [region, time, "ws_mph", "wd_deg"], "observations")
    active = F.col("ws_mph") >= calm
    return (
        obs.where(F.col(region).isNotNull())
        .withWatermark(time, delay)
        .withColumns(
            {
                "speed_bin": F.when(active, speed_bin("ws_mph", speed_breaks)),
                "dir_bin": F.when(active, known_direction_bin("wd_deg", dir_breaks)),
            }
        )
        .groupBy(F.window(time, "1 day").alias("day"), region, "speed_bin", "dir_bin")
        .agg(F.count("*").alias("n"))
    )


def rose_from_counts(counts: DataFrame, region: str = "pyrome_id") -> DataFrame:
    """Non-empty wind-rose cells of accumulated counts: share of the non-calm observations."""
    cells = counts.groupBy(region, "speed_bin", "dir_bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(region)  # at most one row per bin and one for calm
    windy = F.col("speed_bin").isNotNull()
    return (
        cells.withColumns(
            {
                "n_obs": F.sum("n").over(whole),
                "n_noncalm": F.sum(F.when(windy, F.col("n"))).over(whole),
            }
        )
        .where(windy)
        .withColumns(
            {
                "pct": F.col("n") / F.col("n_noncalm") * 100.0,
                "calm_pct": (F.col("n_obs") - F.col("n_noncalm")) / F.col("n_obs") * 100.0,
            }
        )
    )

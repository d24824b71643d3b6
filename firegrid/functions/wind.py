"""Wind vector conversion and wind-rose bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, step

# Default wind-table bins and the calm threshold (mph).
SPEED_BREAKS_MPH = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0)
DIR_BREAKS_DEG = (45.0, 90.0, 135.0, 180.0, 225.0, 270.0, 315.0, 360.0)
CALM_THRESHOLD_MPH = 2.0
MS_TO_MPH = 2.23694


def wind_speed_mph(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(col(u) * col(u) + col(v) * col(v)) * MS_TO_MPH


def wind_direction_deg(u: Column | str, v: Column | str) -> Column:
    """Meteorological direction (where the wind comes from), 0-360."""
    return F.pmod(F.degrees(F.atan2(-col(u), -col(v))) + 360.0, F.lit(360.0))


def upper_bin(value: Column, breaks: Sequence[float]) -> Column:
    """0-based index of the bin whose upper break includes ``value``; the last bin is open."""
    last = len(breaks) - 1
    return step(value, breaks[:last], range(last), closed="right", last=last)


def speed_bin(ws_mph: Column | str, breaks: Sequence[float] = SPEED_BREAKS_MPH) -> Column:
    return upper_bin(col(ws_mph), breaks)


def direction_bin(wd_deg: Column | str, breaks: Sequence[float] = DIR_BREAKS_DEG) -> Column:
    wd = col(wd_deg)
    return upper_bin(F.when(wd == 0.0, F.lit(360.0)).otherwise(wd), breaks)


def circular_mean_deg(mean_sin: Column, mean_cos: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(mean_sin, mean_cos)) + 360.0, F.lit(360.0))


def known_direction_bin(direction: Column | str, dir_breaks: Sequence[float]) -> Column:
    """Direction bin; a missing direction falls into the last one."""
    return F.coalesce(direction_bin(direction, dir_breaks), F.lit(len(dir_breaks) - 1))

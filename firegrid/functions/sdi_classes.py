"""Class tables of the suppression-difficulty index and the index formulas themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, step

# Fixed values of the published index (Rodriguez y Silva et al.): breakpoints and classes.
TENTHS_DOWN = (10, 9, 8, 7, 6, 5, 4, 3, 2)  # then 1
TENTHS_UP = (1, 2, 3, 4, 5, 6, 7, 8, 9)  # then 10
SLOPE_EDGES = (6, 11, 16, 21, 26, 31, 36, 41, 46)
TRAIL_EDGES = (10, 20, 30, 40, 50, 60, 70, 80, 90)
ACCESS_EDGES = (100, 200, 300, 400, 500, 600, 700, 800, 900)
FLAME_EDGES = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5)
HEAT_EDGES = (380, 1265, 1415, 1610, 1905, 2190, 4500, 6630, 8000)
KJ_TO_KCAL = 0.2388459
ASPECT_EDGES = (22.5, 67.5, 112.5, 157.5, 202.5, 247.5, 292.5, 337.5)
ASPECT_CLASSES = (10, 8, 6, 4, 1, 3, 5, 7)  # N NE E SE S SW W NW, then N again


def classify_aspect(aspect: Column | str) -> Column:
    """Aspect in degrees → class; flat (-1) counts as north; missing aspect is class 5."""
    a = col(aspect).cast("double")
    return F.coalesce(step(a, ASPECT_EDGES, ASPECT_CLASSES, last=10), F.lit(5))


def classify_slope_pen(slope_pct: Column | str) -> Column:
    return step(col(slope_pct), SLOPE_EDGES, TENTHS_DOWN, last=1)


def classify_trail_length(metres: Column | str) -> Column:
    return step(col(metres), TRAIL_EDGES, TENTHS_UP, last=10)


def classify_accessibility(metres: Column | str) -> Column:
    """Road distance → class. NULL means farther than the search bound, i.e. class 1."""
    return F.coalesce(
        step(col(metres), ACCESS_EDGES, TENTHS_DOWN, closed="right", last=1), F.lit(1)
    )


def classify_fl(metres: Column | str) -> Column:
    return step(col(metres), FLAME_EDGES, TENTHS_UP, closed="right", last=10)


def classify_hua(kj_per_m2: Column | str) -> Column:
    return step(col(kj_per_m2) * KJ_TO_KCAL, HEAT_EDGES, TENTHS_UP, closed="right", last=10)


def slope_adjust_hand(slope_pct: Column | str, variant: str = "base") -> Column:
    if variant == "smoothed":
        return step(col(slope_pct), (16, 31, 46), (1.0, 0.8, 0.6), last=0.5)
    return step(col(slope_pct), (20, 30, 40), (1.0, 0.75, 0.625), last=0.5)


def slope_adjust_mach(slope_pct: Column | str, variant: str = "base") -> Column:
    if variant == "smoothed":
        return step(
            col(slope_pct), (16, 21, 26, 31, 36), (1.0, 0.8, 0.7, 0.6, 0.5), last=0.0
        )
    return step(col(slope_pct), (30, 40), (1.0, 0.5), last=0.0)


def slope_hazard(slope_pct: Column | str, variant: str = "base") -> Column:
    closed = "left" if variant == "smoothed" else "right"
    return step(
        col(slope_pct), (10, 20, 30, 40, 50), (0.01, 0.1, 0.2, 0.4, 0.6), closed=closed, last=0.8
    )


def slope_pct_from_deg(degrees: Column | str) -> Column:
    return F.tan(F.radians(col(degrees))) * 100.0


def energy(fl_class: Column, hua_class: Column) -> Column:
    """Harmonic mean of the two behaviour classes, 0 when both are 0."""
    total = fl_class + hua_class
    return F.when(total > 0, 2.0 * fl_class * hua_class / total).when(total <= 0, F.lit(0.0))


def penetrability(slope_class: Column, rtc: Column, aspect_class: Column, trail_class: Column):
    return (slope_class + rtc + aspect_class + 2.0 * trail_class) / 5.0


def fireline(rtc: Column, hand: Column, mach: Column) -> Column:
    return rtc * (hand + mach)


def sdi_value(energy_: Column, access: Column, penetr: Column, line: Column) -> Column:
    denominator = access + 1.0 + penetr + line
    return F.when(denominator > 0, energy_ / denominator).when(denominator <= 0, F.lit(0.0))

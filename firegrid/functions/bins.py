"""Flame-length and crown-state classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, lookup, step

# Class limits (2, 4, 8 and 12 ft) and labels of the result tables.
FL_EDGES_M = (0.6096, 1.2192, 2.4384, 3.6576)
FL_EDGES_FT = (2.0, 4.0, 8.0, 12.0)
FL_LABELS = ("0-2ft", "2-4ft", "4-8ft", "8-12ft", ">12ft")
CS_LABELS = ("NonBurnable", "Surface", "Passive Crown", "Active Crown")
CS_SHORT_LABELS = ("NB", "Surface", "Passive", "Active")
FL_MIDPOINTS_FT = (1.0, 3.0, 6.0, 10.0, 15.0)


def bin_raster(value: Column | str, edges: Sequence[float]) -> Column:
    """0-based index of the left-closed bin between interior ``edges``; missing stays NULL."""
    v = col(value)
    return step(v, edges, range(len(edges)), last=len(edges))


def bin_fl(flame_length: Column | str, unit: str = "m") -> Column:
    """Flame-length class 0-4; missing and non-positive lengths are nodata (NULL)."""
    v = col(flame_length)
    edges = {"m": FL_EDGES_M, "ft": FL_EDGES_FT}[unit]
    return F.when(v > 0, bin_raster(v, edges)).cast("byte")


def clean_crown_state(crown_state: Column | str) -> Column:
    v = col(crown_state)
    return F.when(v.between(0, 3), v.cast("byte"))


def class_label(code: Column | str, labels: Sequence[str]) -> Column:
    return lookup(col(code).cast("int"), dict(enumerate(labels)))

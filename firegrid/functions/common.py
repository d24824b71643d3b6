"""Small column helpers used throughout the package."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit ``value`` to [low, high]; NULL stays NULL (``greatest``/``least`` skip NULLs)."""
    out = value
    if high is not None:
        out = F.least(F.lit(float(high)), out)
    if low is not None:
        out = F.greatest(F.lit(float(low)), out)
    return F.when(value.isNotNull(), out)


def step(
    value: Column, edges: Sequence[float], labels: Sequence, *, closed: str = "left", last
) -> Column:
    """First label whose edge lies above ``value``.

    ``closed="left"`` tests ``value < edge`` (bins closed on the left), ``closed="right"`` tests
    ``value <= edge``. Values beyond every edge get ``last``; NULL stays NULL.
    """
    below = (lambda e: value < F.lit(e)) if closed == "left" else (lambda e: value <= F.lit(e))
    out = F.when(value.isNull(), F.lit(None))
    for edge, label in zip(edges, labels, strict=True):
        out = out.when(below(float(edge)), F.lit(label))
    return out.otherwise(F.lit(last))


def lookup(value: Column, table: Mapping) -> Column:
    """Constant dictionary lookup; keys that are absent give NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def missing_to_null(value: Column | str, nodata: float | None = None) -> Column:
    """NaN and the declared nodata value become NULL (Spark sorts NaN above every number)."""
    v = col(value)
    bad = F.isnan(v)
    if nodata is not None:
        bad = bad | (v == F.lit(nodata))
    return F.when(~bad, v)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, as numpy and Python do."""
    return F.bround(value, digits)

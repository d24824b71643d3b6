"""Classification of thinning records as manual or mechanical."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

# Vocabulary of the treatment records.
CUT_PHRASES = (
    "sanitation cut",
    "improvement cut",
    "group selection cut",
    "overstory removal cut",
    "salvage cut",
    "recreation removal",
    "salvage",
)
MANUAL_EQUIPMENT = ("chain saw", "hand work", "hand saw", "manual logging")
MECHANICAL_EQUIPMENT = (
    "feller buncher",
    "tree shear",
    "dozer",
    "masticator",
    "rubber tired skidder logging",
    "helicopter logging -medium",
    "helicopter logging -small",
)
MANUAL_METHODS = ("manual", "power hand", "manual logging", "cut trees and brush")
MECHANICAL_METHODS = (
    "mechanical",
    "tractor logging",
    "logging methods",
    "helicopter",
    "removal",
)


def classify_thin(type_: Column | str, activity: Column | str, equipment: Column | str,
                  method: Column | str) -> Column:
    """``Manual`` / ``Mechanical`` for thinning records, NULL for everything else.

    Equipment decides first, then method; a thinning record without either is mechanical.
    """
    text = lambda c: F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    act, eq, mth = text(activity), text(equipment), text(method)
    words = [F.contains(act, F.lit(w)) for w in ("thin", *CUT_PHRASES)]
    is_thin = reduce(lambda a, b: a | b, words, text(type_) == "thinning")
    return F.when(
        is_thin,
        F.when(eq.isin(*MANUAL_EQUIPMENT), "Manual")
        .when(eq.isin(*MECHANICAL_EQUIPMENT), "Mechanical")
        .when(mth.isin(*MANUAL_METHODS), "Manual")
        .when(mth.isin(*MECHANICAL_METHODS), "Mechanical")
        .otherwise("Mechanical"),
    )

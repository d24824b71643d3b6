"""Data part of the treatment pipeline: treated landscapes, their SDI, the change tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.change import (
    check_types, crown_state_change, flame_length_change, sdi_change, zone_grids,
)
from ..operators.treatment import apply_treatment
from ..schema import Grid, require_columns
from .suppression import calculate_sdi


MAX_TYPES = 1000


def treated_landscapes(
    landscape: DataFrame, parameters: DataFrame, canopy: DataFrame, surface: DataFrame
) -> DataFrame:
    """The landscape under every treatment type, all in one job (``type`` is added).

    ``parameters`` is ``(type, canopy, surface)``: one row per treatment type, at most ``MAX_TYPES``,
    because every pixel is repeated for each of them.
    """
    require_columns(parameters, ["type", "canopy", "surface"], "treatment parameters")
    kinds = parameters.select("type", "canopy", "surface").distinct().limit(MAX_TYPES + 1).collect()
    if len(kinds) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} treatment types")
    options = F.array(
        *[
            F.struct(
                F.lit(k["type"]).alias("type"), F.lit(k["canopy"]).alias("canopy"),
                F.lit(k["surface"]).alias("surface"),
            )
            for k in kinds
        ]
    )
    expanded = landscape.withColumn("_k", F.explode(options)).select(
        *landscape.columns, "_k.type", F.col("_k.canopy").alias("_canopy"),
        F.col("_k.surface").alias("_surface"),
    )
    return apply_treatment(
        expanded, canopy, surface, F.col("_canopy"), F.col("_surface")
    ).drop("_canopy", "_surface")


def run_treatment_pipeline(
    landscape: DataFrame,
    behaviour: DataFrame,
    treated_behaviour: DataFrame,
    spans: DataFrame,
    attrs: DataFrame,
    parameters: DataFrame,
    canopy: DataFrame,
    surface: DataFrame,
    roads: DataFrame,
    trails: DataFrame,
    rtc: DataFrame,
    grid: Grid,
    compute_sdi: bool = True,
    sdi_percentile: str = "Pct90",
    tables: Sequence[str] = ("fl", "cs", "sdi"),
) -> dict[str, DataFrame]:
    """Change tables ``fl``, ``cs`` and ``sdi`` of a treatment plan (or the named ones only).

    The simulator's output is an input here: ``behaviour`` is ``(percentile, row, col,
    flamelength, crownstate, heatarea)``, ``treated_behaviour`` also has ``type``. SDI is computed
    for the baseline and all treated landscapes at ``sdi_percentile``.
    """
    check_types(attrs, parameters)
    out, zones = {}, zone_grids(spans, attrs)
    if "fl" in tables:
        out["fl"] = flame_length_change(behaviour, treated_behaviour, spans, attrs, zones=zones)
    if "cs" in tables:
        out["cs"] = crown_state_change(behaviour, treated_behaviour, spans, attrs, zones=zones)
    if "sdi" not in tables:
        return out
    if not compute_sdi:
        return {**out, "sdi": sdi_change(None, None, spans, attrs)}
    fire = ["row", "col", "flamelength", "heatarea"]
    at = lambda df, *k: df.where(F.col("percentile") == sdi_percentile).select(*k, *fire)
    bl = landscape.join(at(behaviour), ["row", "col"], "left")
    tr = treated_landscapes(landscape, parameters, canopy, surface).join(
        at(treated_behaviour, "type"), ["type", "row", "col"], "left"
    )
    both = bl.withColumn("type", F.lit(None).cast("string")).unionByName(tr)
    sdi = calculate_sdi(both, roads, trails, rtc, grid).select("type", "row", "col", "sdi")
    return {
        **out,
        "sdi": sdi_change(
            sdi.where(F.col("type").isNull()).drop("type"),
            sdi.where(F.col("type").isNotNull()), spans, attrs, zones=zones,
        ),
    }

"""Fuel treatments on landscapes: surface-model remap and canopy effects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns
from ..session import BROADCAST_ROWS, broadcast_if_small, checkpoint

CANOPY_BANDS = {"cc": "cc_AF", "ch": "ch_AF", "cbh": "cbh_AF", "cbd": "cbd_AF"}
FOREST_MIN_COVER = 10


def remap_surface(
    pixels: DataFrame, surface: DataFrame, scenario: Column | str, fuel: str = "fbfm40"
) -> DataFrame:
    """Replace fuel codes through the long surface table ``(scenario, fbfm40, new_fbfm40)``.

    Codes are first limited to [0, highest code of the table]; codes without an entry keep their
    value. The table normally has a few hundred rows (scenarios x codes); it is stored, counted and
    replicated only when it is that small.
    """
    require_columns(surface, ["scenario", "fbfm40", "new_fbfm40"], "surface table")
    name = F.lit(scenario) if isinstance(scenario, str) else scenario
    table = checkpoint(
        surface.select(
            F.col("scenario").alias("_scenario"),
            F.col("fbfm40").cast("int").alias("_code"),
            F.col("new_fbfm40").cast("int").alias("_new"),
        )
    )
    tops = table.groupBy("_scenario").agg(F.max("_code").alias("_top"))
    if table.count() <= BROADCAST_ROWS:
        table, tops = F.broadcast(table), F.broadcast(tops)
    keep = pixels.columns
    kind = pixels.schema[fuel].dataType
    clipped = F.greatest(F.lit(0), F.least(F.col(fuel).cast("int"), F.col("_top")))
    out = (
        pixels.withColumn("_scenario", name)
        .join(tops, "_scenario", "left")
        .withColumn(
            "_code",
            F.when(
                F.col("_top").isNull(),
                F.raise_error(F.concat(F.lit("unknown surface scenario: "), "_scenario")).cast(
                    "int"
                ),
            ).otherwise(F.when(F.col(fuel).isNotNull(), clipped)),
        )
        .join(table, ["_scenario", "_code"], "left")
    )
    new = F.coalesce("_new", "_code").cast(kind)
    return out.select(*[new.alias(c) if c == fuel else F.col(c) for c in keep])


def apply_treatment(
    pixels: DataFrame,
    canopy: DataFrame,
    surface: DataFrame,
    canopy_scenario: Column | str,
    surface_scenario: Column | str,
    band_map: Mapping[str, str] | None = None,
    mask: Column | None = None,
) -> DataFrame:
    """Treated landscape: canopy bands scaled and floored, emptied where the remaining cover
    falls below 10 percent, fuel codes remapped.

    Scenarios are names or columns, so many treatments run in one job. ``band_map`` maps the
    canonical band (``cc``, ``ch``, ``cbh``, ``cbd``, ``fbfm40``) to the table's column. ``mask``
    limits the change to pixels where it is true. Pixels with missing bands keep them missing.
    """
    names = {b: b for b in (*CANOPY_BANDS, "fbfm40")} | dict(band_map or {})
    require_columns(pixels, [names["cc"], names["fbfm40"]], "pixels")
    require_columns(canopy, ["Treatment", *CANOPY_BANDS.values()], "canopy table")
    scenario = F.lit(canopy_scenario) if isinstance(canopy_scenario, str) else canopy_scenario
    factors = canopy.select(
        F.col("Treatment").alias("_trt"),
        *[F.col(f).cast("double").alias(f"_{f}") for f in CANOPY_BANDS.values()],
    )
    keep = pixels.columns
    joined = pixels.withColumn("_trt", scenario).join(
        broadcast_if_small(factors), "_trt", "left"
    )
    known = F.when(
        F.col("_cc_AF").isNull(),
        F.raise_error(F.concat(F.lit("unknown canopy scenario: "), "_trt")).cast("double"),
    ).otherwise(F.col("_cc_AF"))
    forest = F.floor(F.col(names["cc"]) * known) >= FOREST_MIN_COVER
    here = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    changed = {"_here": here, "_forest": forest}
    joined = joined.withColumns(changed)
    edits = {}
    for band, factor in CANOPY_BANDS.items():
        c = names[band]
        if c not in keep:
            continue
        kind = pixels.schema[c].dataType
        treated = F.when(F.col("_forest"), F.floor(F.col(c) * F.col(f"_{factor}"))).when(
            ~F.col("_forest"), F.when(F.col(c).isNotNull(), F.lit(0))
        )
        edits[c] = F.when(F.col("_here"), treated.cast(kind)).otherwise(F.col(c))
    joined = joined.withColumns(edits).withColumn("_old_fuel", F.col(names["fbfm40"]))
    out = remap_surface(joined, surface, surface_scenario, fuel=names["fbfm40"])
    fuel = names["fbfm40"]
    return out.select(
        *[
            F.when(F.col("_here"), F.col(fuel)).otherwise(F.col("_old_fuel")).alias(fuel)
            if c == fuel
            else F.col(c)
            for c in keep
        ]
    )


def crosswalk_effects(records: DataFrame, crosswalk: DataFrame, aliases: DataFrame) -> DataFrame:
    """(agency, treatment) → canopy and surface effect, translated to the effects tables' names.
    ``aliases`` holds the labels of each table under its ``kind`` (CanEff, SurfEff)."""
    require_columns(records, ["agency", "treatment"], "records")
    walk = crosswalk.select(
        F.col("Agency").alias("agency"), F.col("Treatment").alias("treatment"), "CanEff", "SurfEff"
    )
    names = broadcast_if_small(aliases.select("kind", "label", "effect"))
    can = names.where("kind = 'CanEff'").select(
        F.col("label").alias("CanEff"), F.col("effect").alias("_can")
    )
    surf = names.where("kind = 'SurfEff'").select(
        F.col("label").alias("SurfEff"), F.col("effect").alias("_surf")
    )
    return (
        records.join(broadcast_if_small(walk), ["agency", "treatment"], "left")
        .join(can, "CanEff", "left")
        .join(surf, "SurfEff", "left")
        .withColumns(
            {"CanEff": F.coalesce("_can", "CanEff"), "SurfEff": F.coalesce("_surf", "SurfEff")}
        )
        .drop("_can", "_surf")
    )

"""Constant landscapes from fuel and topography parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import col
from ..schema import require_columns

PARAMETERS = (
    "fbfm40", "cc_pct", "cbd_kg_m3", "cbh_m", "ch_m", "elev_m", "slope_pct", "aspect_deg",
)

# The named presets, one row each in the order of ``PARAMETERS``.
PRESETS = {
    "ponderosa_2019": (165, 45, 0.06, 0.3, 15, 2468, 17, -1),
    "ponderosa_2024": (122, 25, 0.06, 0.3, 15, 2468, 17, -1),
    "lodgepole_2019": (183, 55, 0.11, 0.8, 15, 2568, 22, -1),
    "lodgepole_2019_adj": (185, 55, 0.11, 0.56, 15, 2568, 22, -1),
    "lodgepole_2024": (161, 15, 0.03, 3.0, 15, 2568, 22, -1),
    "wetland_2019": (161, 35, 0.01, 10.0, 15, 2391, 2, -1),
    "wetland_2024": (183, 45, 0.01, 10.0, 15, 2391, 2, -1),
    "wetland_custom": (102, 0, 0.0, 0.0, 0, 2391, 2, -1),
    "wetland_gr1": (101, 0, 0.0, 0.0, 0, 2391, 2, -1),
    "wetland_sh1": (141, 0, 0.0, 0.0, 0, 2391, 2, -1),
    "wetland_tu1_opt": (161, 25, 0.01, 10.0, 15, 2391, 2, -1),
}


def presets(spark: SparkSession) -> DataFrame:
    rows = [(name, *(float(v) for v in values)) for name, values in PRESETS.items()]
    return spark.createDataFrame(
        rows, "name string, " + ", ".join(f"{p} double" for p in PARAMETERS)
    )


def encode_bands(evt_code: int = 9999) -> Mapping[str, Column]:
    """Storage encoding of the nine bands: heights x10, bulk density x100, slope in degrees."""
    short = lambda c: F.rint(c).cast("smallint")
    return {
        "elev": short(col("elev_m")),
        "slpd": short(F.degrees(F.atan(col("slope_pct") / 100.0))),
        "asp": col("aspect_deg").cast("smallint"),
        "fbfm40": col("fbfm40").cast("smallint"),
        "cc": short(col("cc_pct")),
        "ch": short(col("ch_m") * 10.0),
        "cbh": short(col("cbh_m") * 10.0),
        "cbd": short(col("cbd_kg_m3") * 100.0),
        "evt": F.lit(evt_code).cast("smallint"),
    }


def synthetic_landscapes(
    params: DataFrame, n_pixels: int = 9, resolution: float = 30.0, evt_code: int = 9999
) -> DataFrame:
    """One ``n_pixels`` x ``n_pixels`` landscape per parameter row (``name`` becomes raster_id)."""
    require_columns(params, ["name", *PARAMETERS], "parameters")
    checked = params.withColumn(
        "cc_pct",
        F.when(col("cc_pct").between(0, 100), col("cc_pct")).otherwise(
            F.raise_error(F.concat(F.lit("cc_pct out of [0, 100] for "), "name")).cast("double")
        ),
    )
    n = int(n_pixels)
    return (
        checked.select(col("name").alias("raster_id"),
                       *[c.alias(b) for b, c in encode_bands(evt_code).items()])
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
        .withColumns(
            {
                "row": F.floor(col("_i") / n).cast("int"),
                "col": (col("_i") % n).cast("int"),
            }
        )
        .withColumns(
            {
                "x": (col("col") + 0.5) * float(resolution),
                "y": n * float(resolution) - (col("row") + 0.5) * float(resolution),
            }
        )
        .drop("_i")
    )

"""Baseline-versus-treated comparison per treatment polygon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import (
    CS_LABELS, CS_SHORT_LABELS, FL_EDGES_FT, FL_LABELS, bin_fl, bin_raster, class_label,
    clean_crown_state,
)
from ..functions.names import safe_name
from ..schema import require_columns
from ..session import checkpoint
from .rasterize import disjoint_spans, join_pixels
from .zonal import zonal_categorical, zonal_continuous

ATTRS = ("feature_id", "ord", "type", "acres_gis")


def check_types(attrs: DataFrame, known: DataFrame, key: str = "type") -> None:
    """Raise when a treatment type has no counterpart; only offending names reach the driver."""
    lost = attrs.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")
    names = [r[0] for r in lost.limit(20).collect()]
    if names:
        raise ValueError(f"treatment types without parameters or rasters: {sorted(map(str, names))}")


def class_change(
    baseline: DataFrame,
    treated: DataFrame,
    spans: DataFrame,
    attrs: DataFrame,
    value: Column,
    labels: Sequence[str],
    prefix: str,
    nodata_in_denominator: bool = False,
    rasters: DataFrame | None = None,
    zones: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Class shares before and after treatment, per (treatment, percentile, class).

    ``baseline`` is ``(percentile, row, col, …)``, ``treated`` additionally carries ``type``.
    The baseline is read over the zone grid of all treatments, each treated raster over the zone
    grid of its own type. Unmatched sides count as 0; delta = treated − baseline. ``rasters`` is
    the catalog ``(type, percentile)`` of the treated rasters; without one it is found by
    aggregating those two columns. ``zones`` are the grids of ``zone_grids``, made here if absent.
    """
    require_columns(attrs, ATTRS, "treatments")
    all_zones, own_zones = zones or zone_grids(spans, attrs)
    keys = ["feature_id", "percentile"]
    kw = {"name": "_class", "nodata_in_denominator": nodata_in_denominator}
    bl = zonal_categorical(join_pixels(baseline, all_zones), value, keys, **kw)
    tr = zonal_categorical(join_pixels(treated, own_zones, on=["type"]), value, keys, **kw)
    present = rasters if rasters is not None else treated.select("type", "percentile").distinct()
    info = attrs.select("feature_id", "type", "acres_gis")
    bl = bl.join(info.select("feature_id", "type"), "feature_id").join(
        present, ["type", "percentile"], "left_semi"
    )
    side = lambda df, s: df.select(
        *keys, "_class", F.col("pixel_count").alias(f"{prefix}_{s}_count"),
        F.col("pct_cover").alias(f"{prefix}_{s}_pct"),
    )
    counts = [f"{prefix}_{s}_{m}" for s in ("bl", "tr") for m in ("count", "pct")]
    merged = (
        side(bl, "bl").join(side(tr, "tr"), [*keys, "_class"], "full_outer").na.fill(0, counts)
    )
    return merged.join(info, "feature_id").select(
        "feature_id", "type", "acres_gis", "percentile", safe_name("type").alias("scenario"),
        class_label("_class", labels).alias(f"{prefix}_class"), *counts,
        (F.col(f"{prefix}_tr_pct") - F.col(f"{prefix}_bl_pct")).alias("delta_pct"),
    )


def zone_grids(spans: DataFrame, attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zone grid of all treatments and zone grids of each type, stored, so that several tables
    (``zones``) share them."""
    return checkpoint(disjoint_spans(spans, attrs)), checkpoint(
        disjoint_spans(spans, attrs, keys=["type"])
    )


def flame_length_change(baseline, treated, spans, attrs, flame: str = "flamelength",
                        unit: str = "m", **kw) -> DataFrame:
    """Flame-length classes before and after treatment (unit of the raster: ``m`` or ``ft``)."""
    return class_change(baseline, treated, spans, attrs, bin_fl(flame, unit), FL_LABELS, "fl", **kw)


def crown_state_change(baseline, treated, spans, attrs, crown: str = "crownstate", **kw):
    """Crown states before and after treatment."""
    return class_change(
        baseline, treated, spans, attrs, clean_crown_state(crown), CS_LABELS, "cs", **kw
    )


def sdi_change(
    baseline: DataFrame | None, treated: DataFrame | None, spans: DataFrame, attrs: DataFrame,
    zones: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Mean suppression difficulty per treatment; delta = baseline − treated. Without rasters the
    same rows come back with NULL metrics."""
    require_columns(attrs, ATTRS, "treatments")
    info = attrs.select(
        "feature_id", "type", "acres_gis", safe_name("type").alias("scenario")
    )
    if baseline is None or treated is None:
        nothing = F.lit(None).cast("double")
        return info.withColumns(
            {"sdi_bl_mean": nothing, "sdi_tr_mean": nothing, "sdi_delta_mean": nothing}
        )
    all_zones, own_zones = zones or zone_grids(spans, attrs)
    mean = lambda df, z, name, **kw: zonal_continuous(
        join_pixels(df, z, **kw), "sdi", ["mean"], scale_factor=100.0
    ).withColumnRenamed("mean", name)
    bl = mean(baseline, all_zones, "sdi_bl_mean")
    tr = mean(treated, own_zones, "sdi_tr_mean", on=["type"])
    present = treated.select("type").distinct()
    return (
        info.join(present, "type", "left_semi")
        .join(bl, "feature_id")
        .join(tr, "feature_id", "left")
        .withColumn("sdi_delta_mean", F.col("sdi_bl_mean") - F.col("sdi_tr_mean"))
        .select("feature_id", "type", "acres_gis", "scenario", "sdi_bl_mean", "sdi_tr_mean",
                "sdi_delta_mean")
    )


def _sides(baseline, treated, touched, attrs, value, on_type=True):
    """All-touched class shares of both sides per (treatment, percentile, class)."""
    types = attrs.select("feature_id", "type")
    keys = ["feature_id", "percentile"]
    bl = zonal_categorical(join_pixels(baseline, touched), value, keys, name="_class")
    tr = zonal_categorical(
        join_pixels(treated, touched.join(types, "feature_id"), on=["type"]), value,
        [*keys, "type"], name="_class",
    )
    return bl, tr


def flame_length_change_ft(
    baseline: DataFrame, treated: DataFrame, touched: DataFrame, attrs: DataFrame,
    flame: str = "flamelength", edges: Sequence[float] = FL_EDGES_FT,
    labels: Sequence[str] = FL_LABELS,
) -> DataFrame:
    """Flame-length classes in feet under the all-touched rule. Classes found on one side only
    keep NULL on the other, and so does their delta."""
    bl, tr = _sides(baseline, treated, touched, attrs, bin_raster(flame, edges))
    b = bl.withColumnsRenamed({"pixel_count": "fl_bl_count", "pct_cover": "fl_bl_pct"})
    t = tr.withColumnsRenamed({"pixel_count": "fl_tr_count", "pct_cover": "fl_tr_pct"})
    return b.join(t, ["feature_id", "percentile", "_class"], "full_outer").select(
        "feature_id", "type", "percentile", class_label("_class", labels).alias("fl_class"),
        "fl_bl_count", "fl_bl_pct", "fl_tr_count", "fl_tr_pct",
        (F.col("fl_tr_pct") - F.col("fl_bl_pct")).alias("delta_pct"),
        F.lit("Flamelength").alias("metric"),
    )


def crown_state_change_touched(
    baseline: DataFrame, treated: DataFrame, touched: DataFrame, attrs: DataFrame,
    crown: str = "crownstate", labels: Sequence[str] = CS_SHORT_LABELS,
) -> DataFrame:
    """Crown states under the all-touched rule: missing percentages count as 0, missing pixel
    counts stay NULL."""
    bl, tr = _sides(baseline, treated, touched, attrs, F.col(crown).cast("int"))
    present = treated.select("type", "percentile").distinct()
    b = (
        bl.join(attrs.select("feature_id", "type"), "feature_id")
        .join(present, ["type", "percentile"], "left_semi")
        .withColumnsRenamed({"pixel_count": "cs_bl_count", "pct_cover": "cs_bl_pct"})
    )
    t = tr.withColumnsRenamed({"pixel_count": "cs_tr_count", "pct_cover": "cs_tr_pct"})
    return (
        b.join(t, ["feature_id", "type", "percentile", "_class"], "full_outer")
        .na.fill(0.0, ["cs_bl_pct", "cs_tr_pct"])
        .select(
            "feature_id", "type", "percentile", class_label("_class", labels).alias("cs_class"),
            "cs_bl_count", "cs_bl_pct", "cs_tr_count", "cs_tr_pct",
            (F.col("cs_tr_pct") - F.col("cs_bl_pct")).alias("delta_pct"),
            F.lit("Crownstate").alias("metric"),
        )
    )


def crown_reduction(zoned: DataFrame, baseline: str = "cs_bl", treated: str = "cs_tr",
                    zone: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Share of the crown-fire pixels (both states above 0) whose state was reduced."""
    valid = (F.col(baseline) > 0) & (F.col(treated) > 0)
    reduced = valid & (F.col(treated) < F.col(baseline))
    return (
        zoned.groupBy(*zone)
        .agg(F.count_if(valid).alias("n_valid"), F.count_if(reduced).alias("n_reduced"))
        .withColumn("prop_reduced", F.try_divide("n_reduced", "n_valid"))
    )

"""Net value change per treatment and per landscape unit, and SDI by position to POD lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import hvra_baseline
from ..schema import Grid, require_columns
from .algebra import mask_conjunction
from .geometry import M2_PER_ACRE_SPREAD
from .rasterize import join_pixels
from .zonal import zonal_continuous


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """One-to-many join check: duplicate left keys are an error."""
    if not df.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"{what}: keys {list(keys)} are not unique")


def project_nvc(
    baseline: DataFrame, treated: DataFrame, touched: DataFrame, attrs: DataFrame,
    hvras: Sequence[str],
) -> DataFrame:
    """Net value change per (treatment, value category, scenario).

    ``baseline`` is ``(hvra, row, col, nvc)`` with totals stored as ``Composite``; ``treated`` is
    ``(hvra, type, row, col, nvc)``. Sums and means are all-touched; deltas are treated −
    baseline; the percentage refers to the absolute baseline sum.
    """
    require_columns(attrs, ["feature_id", "type"], "treatments")
    spark = baseline.sparkSession
    # The caller's list of categories: a handful of names, safe to replicate.
    wanted = spark.createDataFrame([(h,) for h in hvras], "hvra string").withColumn(
        "_stored", hvra_baseline("hvra")
    )
    bl = (
        zonal_continuous(join_pixels(baseline, touched), "nvc", ["sum", "mean", "count"],
                         ["feature_id", "hvra"], prefix="nvc_bl_")
        .withColumnsRenamed({"nvc_bl_count": "nvc_bl_npix", "hvra": "_stored"})
        .join(F.broadcast(wanted), "_stored")
        .drop("_stored")
    )
    require_unique(bl, ["feature_id", "hvra"], "baseline statistics")
    own = touched.join(attrs.select("feature_id", "type"), "feature_id")
    tr = zonal_continuous(
        join_pixels(treated.where(F.col("hvra").isin(list(hvras))), own, on=["type"]), "nvc",
        ["sum", "mean"], ["feature_id", "hvra", "type"], prefix="nvc_tr_",
    )
    delta = F.col("nvc_tr_sum") - F.col("nvc_bl_sum")
    return bl.join(tr, ["feature_id", "hvra"], "left").withColumns(
        {
            "nvc_dlt_sum": delta,
            "nvc_dlt_mean": F.col("nvc_tr_mean") - F.col("nvc_bl_mean"),
            "nvc_pct_chg": F.try_divide(delta, F.abs("nvc_bl_sum")) * 100.0,
        }
    )


def landscape_nvc(
    pixels: DataFrame,
    feasibility: DataFrame,
    unit_spans: DataFrame,
    scenarios: Sequence[str],
    grid: Grid,
    masks: Sequence[str] = (),
    composite: str | None = None,
    min_scenarios: int = 3,
) -> DataFrame:
    """Total, composite-feasible and scenario-feasible value per (unit, category, scenario).

    ``pixels`` is ``(hvra, row, col, nvc, <mask columns>[, composite])``, ``feasibility`` is
    ``(scenario, row, col, feas)``, ``unit_spans`` is ``(unit_name, unit_id, row, c0, c1)``.
    All sums come from one aggregation with conditional sums over the fixed scenario list.
    """
    scenarios = list(scenarios)
    per_cell = feasibility.where(F.col("scenario").isin(scenarios)).groupBy("row", "col").agg(
        *[
            F.max(F.when(F.col("scenario") == s, F.col("feas"))).alias(f"_f{i}")
            for i, s in enumerate(scenarios)
        ]
    )
    allowed = mask_conjunction(*masks)
    joined = pixels.where(F.col("nvc").isNotNull()).withColumn("_ok", allowed)
    joined = join_pixels(joined, unit_spans).join(per_cell, ["row", "col"], "left")
    flags = [F.coalesce(F.col(f"_f{i}") >= 1, F.lit(False)) for i in range(len(scenarios))]
    if composite is not None:
        feasible = F.coalesce(F.col(composite) == 1, F.lit(False))
    else:
        count = sum((f.cast("int") for f in flags), F.lit(0))
        feasible = count >= min_scenarios
    feasible = feasible & F.col("_ok")
    value = F.col("nvc").cast("double")
    aggs = [
        F.sum(value).alias("_total"), F.count(value).alias("_n_total"),
        F.sum(F.when(feasible, value)).alias("_feas"), F.count_if(feasible).alias("_n_feas"),
    ]
    for i in range(len(scenarios)):
        here = F.coalesce(F.col(f"_f{i}") == 1, F.lit(False)) & F.col("_ok")
        aggs += [F.sum(F.when(here, value)).alias(f"_s{i}"), F.count_if(here).alias(f"_n{i}")]
    wide = joined.groupBy("unit_name", "unit_id", "hvra").agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("scenario"), F.col(f"_s{i}").alias("v"),
                    F.col(f"_n{i}").alias("n"),
                )
                for i, s in enumerate(scenarios)
            ]
        )
    )
    acre = grid.cell * grid.cell / M2_PER_ACRE_SPREAD
    return wide.withColumn("_r", rows).select(
        "unit_name", "unit_id", "hvra", F.col("_r.scenario").alias("scenario"),
        F.col("_total").alias("nvc_total"), F.col("_feas").alias("nvc_feas"),
        F.col("_r.v").alias("nvc_feas_scen"),
        (F.col("_n_total") * acre).alias("acres_total"),
        (F.col("_n_feas") * acre).alias("acres_feas"),
        (F.col("_r.n") * acre).alias("acres_feas_scenario"),
    )


def sdi_by_pod_position(
    baseline: DataFrame, treated: DataFrame, touched: DataFrame, attrs: DataFrame,
    pod_flags: DataFrame,
) -> DataFrame:
    """Mean SDI per treatment with its position to POD lines; delta = treated − baseline, in
    percent only where the baseline is at least 1."""
    own = touched.join(attrs.select("feature_id", "type"), "feature_id")
    bl = zonal_continuous(join_pixels(baseline, touched), "sdi", ["mean"])
    tr = zonal_continuous(
        join_pixels(treated, own, on=["type"]), "sdi", ["mean"], ["feature_id", "type"]
    )
    delta = F.col("sdi_tr") - F.col("sdi_bl")
    return (
        bl.withColumnRenamed("mean", "sdi_bl")
        .join(tr.withColumnsRenamed({"mean": "sdi_tr", "type": "scenario"}), "feature_id")
        .join(pod_flags, "feature_id", "left")
        .select(
            "feature_id", "scenario", "pod_line", "sdi_bl", "sdi_tr",
            delta.alias("delta_sdi"),
            F.when(F.col("sdi_bl") >= 1.0, delta / F.col("sdi_bl") * 100.0).alias("delta_sdi_pct"),
        )
    )

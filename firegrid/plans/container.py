"""Preparation of probability runs for many containers, plain or as counterfactual pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlap import lookup_region
from ..operators.rasterize import dissolve_spans, join_pixels
from ..operators.treatment import apply_treatment
from ..schema import require_columns
from ..session import checkpoint, spread
from ..sources.documents import fspro_documents

DOCUMENT_LINES = 64


def _regions(containers: DataFrame, region_spans: DataFrame) -> DataFrame:
    """(container_id, pyrome), stored: documents and manifest both read it."""
    return checkpoint(lookup_region(containers, region_spans, "container_id", "pyrome").select("container_id", "pyrome"))


def _known(probe: str):
    """``pyrome`` as text; an error where the weather's column ``probe`` is missing."""
    return F.when(
        F.col(probe).isNull(),
        F.raise_error(F.concat(F.lit("no weather for region "), F.col("pyrome").cast("string"))),
    ).otherwise(F.col("pyrome").cast("string"))


def _with_weather(regions: DataFrame, bundle: DataFrame) -> DataFrame:
    """Containers whose region has weather."""
    return regions.join(bundle.select("pyrome", "erc_classes"), "pyrome", "left").withColumn("pyrome", _known("erc_classes"))


def _document_lines(regions: DataFrame, bundle: DataFrame, ignition, **overrides) -> DataFrame:
    """(container_id, line_no, line). Documents of one region differ in the last line only, so they are written once a
    region; containers are dealt to tasks by their lines."""
    documents = fspro_documents(bundle, "", **overrides)
    joined = spread(regions, DOCUMENT_LINES, "container_id").join(documents, "pyrome", "left").withColumn("_pyrome", _known("lines"))
    last = F.concat(F.element_at("lines", -1), ignition)
    lines = F.when(F.col("_pyrome").isNotNull(), F.concat(F.slice("lines", 1, F.size("lines") - 1), F.array(last)))
    return joined.select("container_id", F.posexplode(lines).alias("line_no", "line"))


def container_ignitions(container_spans: DataFrame) -> DataFrame:
    """Ignition area per container: the union of its features."""
    return dissolve_spans(container_spans, ["container_id"])


def prepare_containers(
    container_spans: DataFrame,
    region_spans: DataFrame,
    bundle: DataFrame,
    out_dir: str,
    lf_year: str | int,
    lcp_path: str | None = None,
    **overrides,
) -> tuple[DataFrame, DataFrame]:
    """(document lines, manifest) for every container: dominant region, its weather, document.

    ``container_spans`` is ``(container_id, row, c0, c1)``, ``region_spans`` is ``(pyrome, row,
    c0, c1)``.
    """
    require_columns(container_spans, ["container_id", "row", "c0", "c1"], "containers")
    regions = _regions(container_spans, region_spans)
    rows = _with_weather(regions, bundle)
    folder = F.concat(F.lit(f"{out_dir}/"), F.col("container_id").cast("string"))
    ignition = F.concat(folder, F.lit("/ignitions/container_ignition.shp"))
    lines = _document_lines(regions, bundle, ignition, **overrides)
    lcp = F.lit(lcp_path) if lcp_path else F.concat(folder, F.lit(f"/lcp/{lf_year}.tif"))
    manifest = rows.select(
        "container_id", lcp.alias("lcp_path"), ignition.alias("ignition_path"),
        F.concat(folder, F.lit("/fspro_inputs/fspro.input")).alias("fspro_input_path"),
        F.col("pyrome").alias("pyrome_id"), folder.alias("out_dir"),
        F.concat(folder, F.lit("/outputs")).alias("outputs_dir"),
        F.lit(str(lf_year)).alias("lf_year"),
        _parameters(overrides).alias("fspro_kwargs"),
    )
    return lines, manifest


def _parameters(overrides):
    if not overrides:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(str(x)) for kv in overrides.items() for x in kv])


def prepare_counterfactuals(
    container_spans: DataFrame,
    region_spans: DataFrame,
    bundle: DataFrame,
    pixels: DataFrame,
    treatment_spans: DataFrame,
    canopy: DataFrame,
    surface: DataFrame,
    canopy_scenario: str,
    surface_scenario: str,
    out_dir: str,
    lf_year: str | int,
    seed: int = 617327,
    **overrides,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(treated landscape, shared document lines, manifest): the landscape is treated inside the
    treatment polygons only; baseline and treated run share weather and seed."""
    inside = (
        join_pixels(
            pixels, dissolve_spans(treatment_spans.withColumn("_all", F.lit(1)), ["_all"]), how="left"
        )
    )
    treated = apply_treatment(
        inside, canopy, surface, canopy_scenario, surface_scenario,
        mask=F.col("_all").isNotNull(),
    ).drop("_all")
    regions = _regions(container_spans, region_spans)
    rows = _with_weather(regions, bundle)
    folder = F.concat(F.lit(f"{out_dir}/"), F.col("container_id").cast("string"))
    ignition = F.concat(folder, F.lit("/ignitions/container_ignition.shp"))
    lines = _document_lines(regions, bundle, ignition, **{**overrides, "SPOTTING_SEED": seed})
    at = lambda tail: F.concat(folder, F.lit(tail))
    manifest = rows.select(
        "container_id", at(f"/baseline/lcp/{lf_year}.tif").alias("baseline_lcp_path"),
        at("/treated/lcp/treated.tif").alias("treated_lcp_path"),
        ignition.alias("ignition_path"), at("/fspro_inputs/fspro.input").alias("fspro_input_path"),
        at("/baseline/outputs").alias("baseline_outputs_dir"),
        at("/treated/outputs").alias("treated_outputs_dir"),
        F.col("pyrome").alias("pyrome_id"), F.lit(int(seed)).alias("seed"),
        folder.alias("out_dir"), F.lit(str(lf_year)).alias("lf_year"),
        _parameters(overrides).alias("fspro_kwargs"),
    )
    return treated, lines, manifest

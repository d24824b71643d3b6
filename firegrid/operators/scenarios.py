"""Scenario tables: conditions x landscapes, per-scenario inputs, job tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import lookup
from ..functions.names import file_stem, stacked_output_path
from ..schema import require_columns

# Defaults of optional scenario columns.
DEFAULTS = {
    "CROWN_FIRE_METHOD": "ScottReinhardt",
    "GRIDDED_WINDS_GENERATE": "No",
    "GRIDDED_WINDS_RESOLUTION": 30,
    "Outputs": "FLAMELENGTH, CROWNSTATE, SPREADRATE, MIDFLAME, HEATAREA",
    "FM_1000hr": None,
    "ERC": None,
    "FM_NAME": None,
}
MTT_DEFAULTS = {
    "MTT_RESOLUTION": 30,
    "MTT_SIM_TIME": 400,
    "MTT_TRAVEL_PATH_INTERVAL": 50,
    "MTT_SPOT_PROBABILITY": 0.0,
    "MTT_FILL_BARRIERS": 0,
}
NULL_TYPES = {"FM_1000hr": "double", "ERC": "double", "FM_NAME": "string"}


def _default(name: str, value) -> Column:
    return F.lit(None).cast(NULL_TYPES.get(name, "string")) if value is None else F.lit(value)


def build_scenarios(
    conditions: DataFrame, lcps: Sequence[str], outputs: str | None = None, **defaults
) -> DataFrame:
    """Every condition on every landscape, landscape by landscape; absent optional columns get
    their defaults (keyword arguments override them). ``LCP`` is the second column and
    ``lcp_ord`` keeps the order of the landscapes."""
    resolved = {**DEFAULTS, **defaults}
    if outputs is not None:
        resolved["Outputs"] = outputs
    absent = {n: _default(n, v) for n, v in resolved.items() if n not in conditions.columns}
    filled = conditions.withColumns(absent) if absent else conditions
    first, *rest = filled.columns
    # The landscapes are the caller's short list, so they are a constant array, not a join.
    paths = F.array(*[F.lit(str(p)) for p in lcps])
    return filled.select("*", F.posexplode(paths).alias("lcp_ord", "LCP")).select(
        first, "LCP", *rest, "lcp_ord"
    )


def build_mtt_scenarios(conditions, lcps, outputs=None, **defaults) -> DataFrame:
    """:func:`build_scenarios` with the travel-time defaults added."""
    return build_scenarios(conditions, lcps, outputs, **{**MTT_DEFAULTS, **defaults})


def resolve_inputs(
    scenarios: DataFrame,
    ignitions: str | Mapping[str, str] | DataFrame,
    barriers: str | Mapping[str, str] | None = None,
) -> DataFrame:
    """Ignition and barrier file per scenario row: one file for all, or a mapping by scenario.
    A scenario missing from the ignition mapping gets an error status."""
    name = F.col("Scenario").cast("string")
    if isinstance(ignitions, str):
        out = scenarios.withColumn("ignition", F.lit(ignitions))
    elif isinstance(ignitions, DataFrame):
        require_columns(ignitions, ["Scenario", "ignition"], "ignition mapping")
        out = scenarios.join(ignitions.select("Scenario", "ignition"), "Scenario", "left")
    else:
        out = scenarios.withColumn("ignition", lookup(name, ignitions))
    if barriers is None:
        barrier = F.lit(None).cast("string")
    elif isinstance(barriers, str):
        barrier = F.lit(barriers)
    else:
        barrier = lookup(name, barriers)
    problem = F.concat(F.lit("error: no ignition shapefile for scenario '"), name, F.lit("'"))
    return out.withColumns(
        {
            "barrier": barrier,
            "status": F.when(F.col("ignition").isNull(), problem).otherwise(F.lit("success")),
        }
    )


def job_table(
    scenarios: DataFrame, output_root: str, lcp_dir: str | None = None, model: str = "TestFlamMap",
    input_column: str | None = None,
) -> DataFrame:
    """Output folder, log file and expected stack of each scenario row. With ``input_column``
    (prepared input files) rows without an input get an error status."""
    lcp = F.col("LCP")
    if lcp_dir is not None:
        lcp = F.when(lcp.startswith("/"), lcp).otherwise(F.concat(F.lit(f"{lcp_dir}/"), lcp))
    root = F.lit(str(output_root))
    name = F.col("Scenario").cast("string")
    folder = F.concat_ws("/", root, file_stem("LCP"), name)
    status = F.col("status") if "status" in scenarios.columns else F.lit("success")
    if input_column is not None:
        text = f"error: column '{input_column}' not found in scenarios_df row"
        given = F.col(input_column) if input_column in scenarios.columns else F.lit(None)
        status = F.when(given.isNull(), F.lit(text)).otherwise(status)
    return scenarios.select(
        name.alias("Scenario"), lcp.alias("LCP"), folder.alias("output_dir"),
        F.concat(folder, F.lit(f"/{model}_run.log")).alias("log_path"),
        stacked_output_path(root, "LCP", name).alias("stacked_path"),
        status.alias("status"),
    )


def failed_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") != "success")


def status_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"))

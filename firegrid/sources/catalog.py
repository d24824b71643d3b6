"""Raster catalogs: which files exist, what they hold, which scenario they belong to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import file_stem, normalize

# Naming patterns of the analysis rasters, tested in this order.
METRIC_PATTERNS = {
    "eNVC": "envc",
    "cNVC": "cnvc",
    "Feas": "feas",
    "Cost": "cost",
    "SDI": "sdi90",
    "Flamelength": "flamelength",
    "Crownstate": "crownstate",
    "Spreadrate": "spreadrate",
}
# Preferred burn-probability file names per model.
BURN_PROBABILITY_NAMES = {
    "mtt": ("BurnProbability.tif", "burn_probability.tif"),
    "fspro": ("BurnProb.tif", "BurnProbability.tif"),
    "cell2fire": ("BurnProb.tif", "BurnProbability.tif"),
}


def list_files(spark: SparkSession, path: str, ext: str, recursive: bool = True) -> DataFrame:
    """Paths of the files with an extension. Only the listing is read, never the contents."""
    pattern = ext if ext.startswith("*") else f"*{ext}"
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    )


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def classify_metrics(
    files: DataFrame,
    metrics: Sequence[str] | None = None,
    patterns: Mapping[str, str] = METRIC_PATTERNS,
) -> DataFrame:
    """Metric of each file by its lowercase name, first pattern wins; files under a path with
    ``maps`` and files without a match are left out."""
    wanted = {m: p for m, p in patterns.items() if metrics is None or m in metrics}
    name = F.lower(_name())
    metric = F.coalesce(
        *[F.when(name.rlike(p), F.lit(m)) for m, p in wanted.items()], F.lit(None).cast("string")
    )
    return (
        files.where(~F.lower("path").contains("maps"))
        .withColumn("metric", metric)
        .where(F.col("metric").isNotNull())
    )


def match_percentiles(files: DataFrame, percentiles: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(baseline, treated): one baseline file per percentile (first by path) and all treated
    files with the percentiles their name contains."""
    pct = F.explode(F.array(*[F.lit(p) for p in percentiles]))
    tagged = files.withColumn("percentile", pct).where(
        F.contains(F.lower(file_stem("path")), F.lower("percentile"))
    )
    baseline = (
        tagged.where(F.lower("path").contains("baseline"))
        .groupBy("percentile")
        .agg(F.min("path").alias("path"))
    )
    return baseline, tagged.where(F.lower("path").contains("treated"))


def match_scenarios(files: DataFrame, scenarios: DataFrame, scenario: str = "scenario") -> DataFrame:
    """File of each scenario: the stem equals the scenario or starts with ``scenario_``; the
    longest fitting scenario takes a file, the first path takes a scenario.

    A stem has few ``_``-bounded prefixes, so the prefixes are joined instead of comparing every
    stem with every scenario.
    """
    parts = F.split(F.lower(file_stem("path")), "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_")
    )
    names = scenarios.select(scenario, F.lower(scenario).alias("_low")).distinct()
    best = (
        files.withColumn("_low", F.explode(prefixes))
        .join(names, "_low")
        .groupBy("path")
        .agg(F.max_by(scenario, F.length("_low")).alias(scenario))
    )
    return best.groupBy(scenario).agg(F.min("path").alias("path"))


def match_scenarios_normalised(files: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Scenario of each file when separators are ignored: the longest scenario the stem starts
    with. Scenario names are a short fixed list."""
    stem = normalize(file_stem("path"))
    by_length = sorted(scenarios, key=lambda s: (-len(s), s))
    hit = F.coalesce(
        *[F.when(F.startswith(stem, normalize(F.lit(s))), F.lit(s)) for s in by_length]
    )
    return files.withColumn("scenario", hit).where(F.col("scenario").isNotNull())


def find_burn_probability(
    files: DataFrame, model: str = "mtt", folder: str = "folder"
) -> DataFrame:
    """Burn-probability raster per folder: preferred names of the model first, then any ``.tif``
    whose stem contains ``burn`` or ``bp``, by path."""
    preferred = BURN_PROBABILITY_NAMES.get(model, ())
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(preferred))):
        rank = F.when(_name() == name, F.lit(i)).otherwise(rank)
    stem = F.lower(file_stem("path"))
    fallback = F.lower(_name()).endswith(".tif") & (
        F.contains(stem, F.lit("burn")) | F.contains(stem, F.lit("bp"))
    )
    ranked = files.withColumn(
        folder, F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    ).withColumn("_rank", F.coalesce(rank, F.when(fallback, F.lit(len(preferred)))))
    return (
        ranked.where(F.col("_rank").isNotNull())
        .groupBy(folder)
        .agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))
    )


def find_behavior_raster(files: DataFrame, requests: Sequence[tuple[str, str]]) -> DataFrame:
    """Raster per request ``(percentile, band)``: the first file of the folder named after the
    percentile, else the first whose stem contains both band and percentile. A request without
    any file is an error. ``requests`` is the caller's short list."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(p).alias("percentile"), F.lit(b).alias("band")) for p, b in requests]
        )
    )
    parent = F.element_at(F.split("path", "/"), -2)
    stem = F.lower(file_stem("path"))
    in_folder = parent == F.col("percentile")
    named = F.contains(stem, F.lower("percentile")) & F.contains(stem, F.lower("band"))
    found = (
        files.where(F.lower("path").endswith(".tif"))
        .withColumn("_p", pairs)
        .select("path", "_p.percentile", "_p.band")
        .where(in_folder | named)
        .groupBy("percentile", "band")
        .agg(F.min_by("path", F.struct((~in_folder).cast("int"), F.col("path"))).alias("path"))
    )
    wanted = files.sparkSession.createDataFrame(list(requests), "percentile string, band string")
    problem = F.raise_error(F.concat(F.lit("no raster for "), "percentile", F.lit(" "), "band"))
    return wanted.join(found, ["percentile", "band"], "left").select(
        "percentile", "band", F.coalesce("path", problem.cast("string")).alias("path")
    )

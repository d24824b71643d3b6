"""Name, label and key functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col, half_even, lookup

# Road classes and their codes.
HIGHWAY_CODES = {
    "motorway": 1,
    "trunk": 2,
    "primary": 3,
    "secondary": 4,
    "tertiary": 5,
    "unclassified": 6,
    "residential": 7,
    "service": 8,
    "track": 9,
}
TRAIL_TYPES = ("path", "footway", "bridleway", "track")


def safe_name(name: Column | str) -> Column:
    return F.lower(F.translate(col(name), " /", "_-"))


def file_stem(path: Column | str) -> Column:
    """File name without folder and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def normalize_band_name(name: Column | str) -> Column:
    """Second ``_`` token; a name without ``_`` is already normalised."""
    return F.coalesce(F.get(F.split(col(name), "_"), F.lit(1)), col(name))


def band_label(name: Column | str) -> Column:
    """Short label of a landscape product: region prefix, version and year removed."""
    n = col(name)
    for pattern in (r"^[A-Z]{2}_", r"^\d{3}", r"_\d{2}$", r"\d{4}$"):
        n = F.regexp_replace(n, pattern, "")
    return F.when(n == "F40", "FBFM40").when(n == "SLPD", "SLP").otherwise(n)


def normalize(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(name), "[-_]", ""))


def flatten_tag(tag: Column | str, missing: str = "") -> Column:
    """First element of a list-valued tag."""
    return F.coalesce(F.get(col(tag), F.lit(0)), F.lit(missing))


def tag_text(tag: Column | str, missing: str = "unknown") -> Column:
    """List-valued tag as comma-separated text."""
    return F.when(F.size(F.coalesce(col(tag), F.array().cast("array<string>"))) > 0,
                  F.array_join(col(tag), ", ")).otherwise(F.lit(missing))


def highway_code(highway: Column | str) -> Column:
    return lookup(col(highway), HIGHWAY_CODES)


def stacked_output_path(root: Column, lcp: Column | str, scenario: Column | str) -> Column:
    stem = file_stem(lcp)
    return F.concat_ws(
        "/", root, stem, col(scenario), F.concat(col(scenario), F.lit("_"), F.upper(stem), F.lit(".tif"))
    )


def treatment_field(raster_name: Column | str) -> Column:
    """Field name built from a delta raster's name: text before the ``sdi`` token plus its
    percentile, without underscores (``mech_thin_delta_sdi_Pct90_x`` → ``mechthindeltasdi90``)."""
    stem = file_stem(raster_name)
    before = F.regexp_extract(stem, r"^(.*?)_sdi(_|$)", 1)
    pct = F.regexp_extract(stem, r"(?:^|_)Pct([^_]*)", 1)
    return F.concat(F.regexp_replace(before, "_", ""), F.lit("sdi"), pct)


def percentile_key(p: Column | float) -> Column:
    p = F.lit(float(p)) if isinstance(p, (int, float)) else p
    return F.concat(F.lit("p"), half_even(p * 100).cast("int").cast("string"))


def hvra_code(hvra: Column | str, table: Mapping[str, str] | None = None) -> Column:
    """Code of a value category: from a table when one is given, else the name itself."""
    return lookup(col(hvra), table) if table else col(hvra)


def hvra_baseline(hvra: Column | str) -> Column:
    """Name under which the baseline of a category is stored (totals are ``Composite``)."""
    return F.when(col(hvra).isin("Total", "Composite"), F.lit("Composite")).otherwise(col(hvra))

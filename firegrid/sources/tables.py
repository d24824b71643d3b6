"""CSV and text inputs: daily climatology, scenarios, lookup and effects tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nfdrs import kelvin_to_fahrenheit
from ..functions.wind import MS_TO_MPH
from ..schema import MissingColumnsError, require_columns

CLIMATE_REQUIRED = ("pyrome", "date", "erc", "fm100", "fm1000", "tmmx", "rmin")
SCENARIO_REQUIRED = (
    "Scenario", "LCP", "WIND_SPEED", "WIND_DIRECTION", "FM_1hr", "FM_10hr", "FM_100hr", "FM_herb",
    "FM_woody", "CROWN_FIRE_METHOD", "Outputs",
)

# Canopy adjustment factors per treatment
# (bulk density, base height, cover, height).
CANOPY_EFFECTS = {
    "Thin": (0.6, 1.2, 0.7, 1.2),
    "Hand Thin": (0.8, 1.1, 0.75, 1.1),
    "Mech Thin": (0.6, 1.3, 0.6, 1.3),
    "RxFire": (0.92, 1.09, 0.95, 1.13),
    "Complete Hand": (0.8, 1.1, 0.75, 1.1),
    "Complete Mech": (0.6, 1.3, 0.6, 1.3),
    "Masticate": (0.8, 1.1, 0.75, 1.1),
    "Patch": (0.0, 0.0, 0.0, 0.0),
    "LowSevWF": (0.85, 1.1, 0.85, 1.1),
    "ModSevWF": (0.45, 1.25, 0.45, 1.25),
    "HighSevWF": (0.1, 1.5, 0.1, 1.5),
    "Overstory": (0.8, 1.0, 0.8, 0.5),
}
# Resistance to control per fuel model (western US table).
RTC = {
    101: 10, 102: 10, 103: 10, 104: 10, 105: 10, 106: 10, 107: 3, 108: 3, 109: 3,
    121: 10, 122: 10, 123: 10, 124: 3,
    141: 4, 142: 4, 143: 3, 144: 3, 145: 2, 146: 4, 147: 2, 148: 2, 149: 2,
    161: 8, 162: 8, 163: 4, 164: 4, 165: 4,
    181: 8, 182: 10, 183: 8, 184: 4, 185: 2, 186: 10, 187: 2, 188: 8, 189: 8,
    201: 4, 202: 4, 203: 1, 204: 1, 205: 1,
}
# Agency treatment → canopy and surface effect.
CROSSWALK = (
    ("DOI", "Biomass Removal", "None", "Manage"),
    ("DOI", "Broadcast Burn", "Rx fire", "Rx fire"),
    ("DOI", "Hand Pile", "None", "Manage"),
    ("DOI", "Hand Pile Burn", "None", "Manage"),
    ("DOI", "Machine Pile Burn", "None", "Manage"),
    ("DOI", "Mowing", "None", "Manage"),
    ("DOI", "Thinning", "Thin", "None"),
    ("USFS", "Biomass Removal", "None", "Manage"),
    ("USFS", "Broadcast Burn", "Rx fire", "Rx fire"),
    ("USFS", "Crushing", "None", "Masticate"),
    ("USFS", "Grazing", "None", "Manage"),
    ("USFS", "Lop and Scatter", "None", "Lop and scatter"),
    ("USFS", "Machine Pile", "None", "Manage"),
    ("USFS", "Machine Pile Burn", "None", "Manage"),
    ("USFS", "Thinning", "Thin", "None"),
    ("USFS", "Chemical", "None", "None"),
    ("USFS", "Chipping", "None", "Masticate"),
    ("USFS", "Fire Use", "Rx fire", "Rx fire"),
    ("USFS", "Jackpot Burn", "Rx fire", "Rx fire"),
    ("USFS", "N/A", "None", "None"),
)
# Crosswalk labels as the effects tables spell them; the two tables differ.
EFFECT_ALIASES = {
    "CanEff": {"Rx fire": "RxFire"},
    "SurfEff": {
        "Rx fire": "RxFire",
        "Lop and scatter": "Rearrange",
        "Masticate": "Mastication",
    },
}


def canopy_effects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, *factors) for name, factors in CANOPY_EFFECTS.items()],
        "Treatment string, cbd_AF double, cbh_AF double, cc_AF double, ch_AF double",
    )


def rtc_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in RTC.items()], "code int, rtc double")


def crosswalk_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(CROSSWALK), "Agency string, Treatment string, CanEff string, SurfEff string"
    )


def effect_aliases(spark: SparkSession) -> DataFrame:
    rows = [(kind, *pair) for kind, names in EFFECT_ALIASES.items() for pair in names.items()]
    return spark.createDataFrame(rows, "kind string, label string, effect string")


def normalise_climatology(raw: DataFrame) -> DataFrame:
    """Daily climatology with derived columns: year, doy, °F temperatures, wind in mph.

    Names are trimmed and lowercased, text that is not a number becomes NULL, rows without ERC
    or region are dropped.
    """
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    require_columns(df, CLIMATE_REQUIRED, "climatology")
    have = set(df.columns)
    num = lambda c: F.col(c).try_cast("double")
    date = F.to_date("date")
    derived = {
        "date": date,
        "year": num("year").cast("int") if "year" in have else F.year(date),
        "doy": num("doy").cast("int") if "doy" in have else F.dayofyear(date),
        "tmmx_f": kelvin_to_fahrenheit(num("tmmx")),
    }
    for name in ("erc", "fm100", "fm1000", "rmin", "rmax", "pr"):
        if name in have:
            derived[name] = num(name)
    if "tmmn" in have:
        derived["tmmn_f"] = kelvin_to_fahrenheit(num("tmmn"))
    if "vs" in have:
        derived["ws_mph"] = num("vs") * MS_TO_MPH
    if "th" in have:
        derived["wd_deg"] = num("th")
    kept = [c for c in df.columns if c not in ("tmmx", "tmmn", "vs", "th", *derived)]
    return df.select(
        *kept, *[c.alias(n) for n, c in derived.items()]
    ).where(F.col("erc").isNotNull() & F.col("pyrome").isNotNull())


def read_climatology(spark: SparkSession, path: str) -> DataFrame:
    return normalise_climatology(spark.read.csv(path, header=True))


def climatology_report(raw: DataFrame) -> DataFrame:
    """Rows kept, rows dropped, regions and year range of a raw climatology, in one pass."""
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    erc = F.col("erc").try_cast("double")
    keep = erc.isNotNull() & F.col("pyrome").isNotNull()
    year = F.col("year").try_cast("int") if "year" in df.columns else F.year(F.to_date("date"))
    return df.agg(
        F.count_if(keep).alias("n_rows"), F.count_if(~keep).alias("n_dropped"),
        F.count_distinct(F.when(keep, F.col("pyrome"))).alias("n_pyromes"),
        F.min(F.when(keep, year)).alias("first_year"), F.max(F.when(keep, year)).alias("last_year"),
    )


def resolve_scenarios(raw: DataFrame, lcp_dir: str | None = None) -> DataFrame:
    """Scenario table with its required columns checked and relative landscape paths resolved."""
    require_columns(raw, SCENARIO_REQUIRED, "scenario table")
    if lcp_dir is None:
        return raw
    lcp = F.col("LCP")
    return raw.withColumn(
        "LCP", F.when(lcp.startswith("/"), lcp).otherwise(F.concat(F.lit(f"{lcp_dir}/"), lcp))
    )


def read_scenarios(spark: SparkSession, path: str, lcp_dir: str | None = None) -> DataFrame:
    return resolve_scenarios(spark.read.csv(path, header=True, inferSchema=True, escape='"'), lcp_dir)


def parse_rtc(lines: DataFrame) -> DataFrame:
    """``code:value`` lines → ``(code, rtc)``. Blanks and ``#`` lines are skipped; anything else
    must parse, or the job fails naming the line."""
    text = F.trim("value")
    parts = F.split(text, ":")
    code, value = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("double")
    ok = (F.size(parts) == 2) & code.isNotNull() & value.isNotNull()
    problem = F.raise_error(
        F.concat(F.lit("cannot parse line "), (F.col("line_no") + 1).cast("string"), F.lit(": "), text)
    )
    return lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(
        F.when(ok, code).otherwise(problem.cast("int")).alias("code"), value.alias("rtc")
    )


def read_rtc(spark: SparkSession, path: str) -> DataFrame:
    """Resistance-to-control table of a text file; an empty one is an error."""
    from .ascii_grid import numbered_lines

    table = parse_rtc(numbered_lines(spark, path))
    if table.isEmpty():
        raise ValueError(f"no entries in lookup table {path}")
    return table


def unpivot_surface(wide: DataFrame, code: str = "Code", fuel: str = "FBFM40") -> DataFrame:
    """Surface-effects table (one column per scenario) → ``(scenario, fbfm40, new_fbfm40)``."""
    scenarios = [c for c in wide.columns if c not in (code, fuel)]
    if not scenarios:
        raise MissingColumnsError("surface table has no scenario columns")
    typed = wide.select(
        F.col(fuel).cast("int").alias("fbfm40"), *[F.col(c).cast("int").alias(c) for c in scenarios]
    )
    return typed.unpivot(["fbfm40"], scenarios, "scenario", "new_fbfm40").select(
        "scenario", "fbfm40", "new_fbfm40"
    )


def read_effects(spark: SparkSession, canopy_path: str, surface_path: str):
    canopy = spark.read.csv(canopy_path, header=True)
    canopy = canopy.select(
        "Treatment", *[F.col(c).cast("double").alias(c) for c in canopy.columns if c != "Treatment"]
    )
    return canopy, unpivot_surface(spark.read.csv(surface_path, header=True))

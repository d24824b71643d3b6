"""Text documents of simulator inputs, assembled as ordered lines per region or scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import half_even
from ..functions.wind import DIR_BREAKS_DEG, SPEED_BREAKS_MPH
from ..operators.scenarios import MTT_DEFAULTS
from ..schema import require_columns
from ..session import checkpoint

# Default keys of the probability-run document.
FSPRO_DEFAULTS = {
    "Dimension": 2,
    "Resolution": 90.0,
    "Duration": 7,
    "NumFires": 1000,
    "MaxLag": 30,
    "PolyDegree": 9,
    "ThreadsPerFire": 1,
    "UseCustomFuels": 0,
    "SPOTTING_SEED": 617327,
    "CROWN_FIRE_METHOD": "Finney",
    "BarrierFill": 0,
    "SavePerimeters": 1,
    "NumForecast": 0,
}
_HEADER_KEYS = (
    "Dimension", "Resolution", "Duration", "NumFires", "MaxLag", "PolyDegree", "ThreadsPerFire",
    "UseCustomFuels", "SPOTTING_SEED", "CROWN_FIRE_METHOD",
)


def fixed(value: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, ties to even; a missing one reads ``nan``."""
    text = F.format_string(f"%.{digits}f", half_even(value.cast("double"), digits))
    return F.when(value.isNotNull(), text).otherwise(F.lit("nan"))


def _joined(values: Column, digits: int) -> Column:
    return F.concat_ws(" ", F.transform(values, lambda v: fixed(v, digits)))


def fspro_documents(
    bundle: DataFrame,
    ignition_file: Column | str,
    key: str = "pyrome",
    speed_breaks=SPEED_BREAKS_MPH,
    dir_breaks=DIR_BREAKS_DEG,
    forecast: list[tuple] | None = None,
    **overrides,
) -> DataFrame:
    """``(key, lines)``: the probability-run document of every bundle row; its last line names the ignition file.

    ``bundle`` rows hold ``wind_cells`` (speed x direction), ``calm_value``, ``erc_historic``
    (year x day), ``erc_avg``, ``erc_std``, ``erc_classes`` (structs), ``current_erc``. A document
    is built inside its row, without joins.
    """
    need = ["wind_cells", "calm_value", "erc_historic", "erc_avg", "erc_std", "erc_classes",
            "current_erc", key]
    require_columns(bundle, need, "weather bundle")
    params = {**FSPRO_DEFAULTS, **overrides}
    if forecast is not None:
        params["NumForecast"] = len(forecast)
    ignition = F.lit(ignition_file) if isinstance(ignition_file, str) else ignition_file
    text = lambda s: F.lit(str(s))
    size = lambda label, c: F.concat(F.lit(f"{label}: "), F.size(c).cast("string"))
    breaks = lambda b: text(" ".join(str(int(v)) for v in b))
    c = F.col

    def erc_row(r: Column) -> Column:
        return F.concat_ws(
            " ", fixed(r["lower"], 0), fixed(r["upper"], 0), fixed(r["fm1"], 1),
            fixed(r["fm10"], 1), fixed(r["fm100"], 1), fixed(r["fm_herb"], 1),
            fixed(r["fm_woody"], 1), fixed(r["spot_dist"], 0), fixed(r["spot_prob"], 2),
            fixed(r["spot2"], 0),
        )

    blocks = [
        F.array(
            text("FSPRO-Inputs-File-Version-4"),
            *[text(f"{k}: {params[k]}") for k in _HEADER_KEYS],
            F.concat(F.lit("CalmValue: "), fixed(c("calm_value"), 2)),
            size("NumWindDirs", c("wind_cells")[0]), breaks(dir_breaks),
            size("NumWindSpeeds", c("wind_cells")), breaks(speed_breaks),
            text("WindCellValues:"),
        ),
        F.transform("wind_cells", lambda r: _joined(r, 2)),
        F.array(size("NumERCClasses", c("erc_classes"))),
        F.transform("erc_classes", erc_row),
        F.array(
            size("NumERCYears", c("erc_historic")), size("NumWxPerYear", c("erc_historic")[0]),
            text("HistoricERCValues: "),
        ),
        F.transform("erc_historic", lambda r: _joined(r, 0)),
        F.array(
            text("AvgERCValues: "), _joined(c("erc_avg"), 1), text("StdDevERCValues:"),
            _joined(c("erc_std"), 2), size("NumWxCurrYear", c("current_erc")),
            text("CurrentERCValues: "), _joined(c("current_erc"), 0),
            text(f"NumForecast: {params['NumForecast']}"),
            *[text(" ".join(str(v) for v in row)) for row in forecast or []],
            text(f"BarrierFill: {params['BarrierFill']}"),
            text(f"SavePerimeters: {params['SavePerimeters']}"),
            F.concat(F.lit("IgnitionFile: "), ignition),
        ),
    ]
    return bundle.select(key, F.concat(*blocks).alias("lines"))


def fspro_lines(bundle: DataFrame, ignition_file: Column | str, key: str = "pyrome", **settings) -> DataFrame:
    """``(key, line_no, line)`` of :func:`fspro_documents`, which takes the ``settings``."""
    return fspro_documents(bundle, ignition_file, key, **settings).select(key, F.posexplode("lines").alias("line_no", "line"))


def paired_lines(bundle: DataFrame, ignition_file, seed: int = 617327, **overrides) -> DataFrame:
    """The same document with a forced shared seed (the argument beats a seed given as key)."""
    return fspro_lines(bundle, ignition_file, **{**overrides, "SPOTTING_SEED": seed})


def _as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _moisture_line() -> Column:
    names = ("FM_1hr", "FM_10hr", "FM_100hr", "FM_herb", "FM_woody")
    return F.concat_ws(" ", F.lit("0"), *[_as_text(n) for n in names])


def _behaviour_block(df: DataFrame, n_process: int) -> list[Column]:
    line = lambda k: F.array(F.concat(F.lit(f"{k}: "), _as_text(k)))
    blocks = [
        F.array(F.lit("FOLIAR_MOISTURE_CONTENT: 100")), line("CROWN_FIRE_METHOD"),
        F.array(F.lit(f"NUMBER_PROCESSORS: {n_process}")), line("WIND_SPEED"),
        line("WIND_DIRECTION"),
    ]
    if "GRIDDED_WINDS_GENERATE" in df.columns:
        gridded = F.array(
            F.lit("GRIDDED_WINDS_GENERATE: Yes"),
            F.concat(F.lit("GRIDDED_WINDS_RESOLUTION: "), _as_text("GRIDDED_WINDS_RESOLUTION")),
        )
        blocks.append(
            F.when(F.col("GRIDDED_WINDS_GENERATE") == "Yes", gridded).otherwise(
                F.array().cast("array<string>")
            )
        )
    return blocks


def _output_lines(suffix: str) -> Column:
    names = F.transform(F.split(F.coalesce("Outputs", F.lit("")), ","), lambda o: F.trim(o))
    return F.transform(
        F.filter(names, lambda o: o != ""), lambda o: F.concat(o, F.lit(suffix))
    )


def shortterm_lines(
    scenarios: DataFrame, keys: list[str], n_process: int = 1, model: str = "flammap"
) -> DataFrame:
    """``(keys, line_no, line)`` of the short-term document of each scenario row. ``model`` is
    ``flammap`` (outputs as ``NAME: 1``) or ``mtt`` (travel-time keys, outputs as ``NAME:``)."""
    require_columns(scenarios, [*keys, "FM_1hr", "WIND_SPEED", "Outputs"], "scenarios")
    blocks = [
        F.array(
            F.lit("ShortTerm-Inputs-File-Version-1"), F.lit(""), F.lit("FUEL_MOISTURES_DATA: 1"),
            _moisture_line(),
        ),
        *_behaviour_block(scenarios, n_process),
    ]
    if model == "mtt":
        require_columns(scenarios, MTT_DEFAULTS, "travel-time scenarios")
        blocks.append(
            F.array(*[F.concat(F.lit(f"{k}: "), _as_text(k)) for k in MTT_DEFAULTS])
        )
        blocks.append(_output_lines(":"))
    else:
        blocks.append(_output_lines(": 1"))
    return scenarios.select(*keys, F.posexplode(F.concat(*blocks)).alias("line_no", "line"))


def conditioning_lines(
    scenarios: DataFrame,
    weather: DataFrame,
    wind: DataFrame,
    conditioning_end: str,
    key: str = "pyrome",
    n_process: int = 1,
) -> DataFrame:
    """``(key, line_no, line)`` of the conditioning-period document per region.

    ``weather`` are daily weather rows and ``wind`` hourly wind rows of the same ``key``. Their lines
    are numbered behind each other; no document is gathered in one row. A region without weather or
    without wind ends the job.
    """
    space = lambda *cols: F.concat_ws(" ", *[F.col(x).cast("string") for x in cols])
    daily = weather.select(
        key, F.col("date").alias("_at"),
        space("month", "day", "pcp", "min_t_hour", "max_t_hour", "min_t", "max_t", "max_rh", "min_rh",
              "elev_ft", "precip_start", "precip_end").alias("line"),
    )
    hourly = wind.select(
        key, F.col("time").alias("_at"),
        space("month", "day", "hhmm", "speed", "direction", "cloud_cover").alias("line"),
    )
    need = lambda n, what: F.coalesce(
        F.col(n),
        F.raise_error(F.concat(F.lit(f"no {what} for region "), F.col(key).cast("string"))).cast("bigint"),
    )
    base = checkpoint(
        scenarios.join(daily.groupBy(key).agg(F.count("*").alias("_wx")), key, "left")
        .join(hourly.groupBy(key).agg(F.count("*").alias("_wind")), key, "left")
        .withColumns({"_wx": need("_wx", "weather"), "_wind": need("_wind", "wind")})
    )
    stamp = F.date_format(F.lit(conditioning_end).cast("timestamp"), "MM dd HHmm")
    count = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))
    head = F.array(
        F.lit("FlamMap-Inputs-File-Version-1"),
        F.concat(F.lit("CONDITIONING_PERIOD_END: "), stamp), F.lit(""),
        F.lit("FUEL_MOISTURES_DATA: 1"), _moisture_line(), F.lit(""),
        count("WEATHER_DATA", "_wx"),
        F.lit("# Mth Day Pcp mTH xTH mT xT mH xH Elv PST PET"),
    )
    between = F.array(
        F.lit(""), count("WIND_DATA", "_wind"), F.lit("# Mth Day Hour Speed Direction CloudCover")
    )
    tail = F.concat(F.array(F.lit("")), *_behaviour_block(scenarios, n_process), _output_lines(":"))
    n_head, n_between = 8, 3  # lines of the two arrays

    def block(lines: Column, first: Column) -> DataFrame:
        rows = base.select(key, first.alias("_first"), F.posexplode(lines).alias("_i", "line"))
        return rows.select(key, (F.col("_first") + F.col("_i")).alias("line_no"), "line")

    def numbered(rows: DataFrame, first: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("_at", "line")) - 1
        sizes = base.select(key, first.alias("_first"))
        return rows.withColumn("_i", place).join(sizes, key).select(
            key, (F.col("_first") + F.col("_i")).alias("line_no"), "line"
        )

    zero = F.lit(0).cast("bigint")
    at_wind = zero + n_head + F.col("_wx") + n_between
    return (
        block(head, zero)
        .unionByName(numbered(daily, zero + n_head))
        .unionByName(block(between, zero + n_head + F.col("_wx")))
        .unionByName(numbered(hourly, at_wind))
        .unionByName(block(tail, at_wind + F.col("_wind")))
    )

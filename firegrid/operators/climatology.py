"""Fire-season climatology per region: ERC seasons, classes, fuel moistures, weather rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nfdrs
from ..functions.common import half_even
from ..functions.names import percentile_key
from ..functions.wind import circular_mean_deg
from ..schema import require_columns
from ..session import broadcast_if_small, checkpoint
from .quantiles import exact_quantiles, medians


def _limits(df: DataFrame) -> DataFrame:
    """Per-region quantile limits, computed once and replicated when their count allows, so that
    the weather table itself is not shuffled to meet them."""
    return broadcast_if_small(df)


SEASON_DAYS = 214
SEASON_DOY = (91, 304)

# Spotting distance (ft), probability and second parameter, most extreme class first.
SPOTTING = (
    (360.0, 0.15, 0.0),
    (300.0, 0.10, 0.0),
    (240.0, 0.05, 0.0),
    (180.0, 0.01, 0.0),
    (120.0, 0.00, 0.0),
)
PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.97)


def season_day(date: Column | str, year: Column | str) -> Column:
    """Day of the fire season: April 1 is 1 in leap years too."""
    d = F.col(date) if isinstance(date, str) else date
    y = F.col(year) if isinstance(year, str) else year
    return F.datediff(d, F.make_date(y.cast("int"), F.lit(4), F.lit(1))) + 1


def season_erc(wx: DataFrame, region: str = "pyrome") -> DataFrame:
    """Complete season table ``(region, year, dos, erc, filled)``.

    Duplicate days are averaged; a missing day takes the median of that day over the region's
    years (NULL when no year has it). After the daily aggregation a region has at most
    years x 214 rows, so the medians run over a handful of years each.
    """
    require_columns(wx, [region, "date", "year", "erc"], "weather")
    daily = (
        wx.withColumn("dos", season_day("date", "year"))
        .where(F.col("dos").between(1, SEASON_DAYS))
        .groupBy(region, "year", "dos")
        .agg(F.avg("erc").alias("erc"))
    )
    scaffold = (
        daily.select(region, "year").distinct()
        .withColumn("dos", F.explode(F.sequence(F.lit(1), F.lit(SEASON_DAYS))))
    )
    by_day = daily.groupBy(region, "dos").agg(F.median("erc").alias("_median"))
    return (
        scaffold.join(daily, [region, "year", "dos"], "left")
        .join(by_day, [region, "dos"], "left")
        .select(
            region, "year", "dos", F.coalesce("erc", "_median").alias("erc"),
            F.col("erc").isNull().alias("filled"),
        )
    )


def season_matrix(season: DataFrame, region: str = "pyrome", n_years: int = 15) -> DataFrame:
    """One row per region with the years, the year x day matrix and a flag when the number of
    years differs from the expected one (a matrix is at most years x 214 values)."""
    rows = season.groupBy(region, "year").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("dos", "erc"))), lambda s: s["erc"]
        ).alias("values")
    )
    ordered = F.array_sort(F.collect_list(F.struct("year", "values")))
    return rows.groupBy(region).agg(ordered.alias("_y")).select(
        region,
        F.transform("_y", lambda s: s["year"]).alias("years"),
        F.transform("_y", lambda s: s["values"]).alias("erc"),
        (F.size("_y") != n_years).alias("unexpected_years"),
    )


def erc_stats(season: DataFrame, region: str = "pyrome", digits: int = 2) -> DataFrame:
    """Mean and sample standard deviation per season day over the years, two digits."""
    return season.groupBy(region, "dos").agg(
        half_even(F.avg("erc"), digits).alias("erc_avg"),
        half_even(F.stddev_samp("erc"), digits).alias("erc_std"),
    )


def current_erc(
    season: DataFrame, start_dos: int, n_days: int = 79, region: str = "pyrome"
) -> DataFrame:
    """Median season over the years for a window of days, as whole numbers."""
    end = start_dos - 1 + n_days
    if end > SEASON_DAYS:
        raise ValueError(f"window ends on season day {end}, past {SEASON_DAYS}")
    return (
        season.where(F.col("dos").between(start_dos, end))
        .groupBy(region, "dos")
        .agg(half_even(F.median("erc"), 0).cast("int").alias("erc"))
    )


def _dead_fuel() -> dict[str, Column]:
    return {
        "emc": nfdrs.calc_emc("tmmx_f", "rmin"),
        "fm100": F.col("fm100"),
        "doy": F.col("doy"),
    }


def _dead_medians(emc: str = "emc") -> tuple[Column, Column]:
    """1-h and 10-h moisture from the median equilibrium moisture: both are constant multiples of
    it, so the median of the multiple is the multiple of the median."""
    return F.col(emc) * nfdrs.FM_1HR_FACTOR, F.col(emc) * nfdrs.FM_10HR_FACTOR


def erc_classes(
    wx: DataFrame,
    region: str = "pyrome",
    n_classes: int = 5,
    spotting: Sequence[Sequence[float]] = SPOTTING,
) -> DataFrame:
    """ERC classes per region, most extreme first, with median fuel moistures.

    Class limits are equal-count quantiles; classes are closed on both sides, so a value on a
    limit belongs to both neighbours. A class between two observations may be empty; it takes the
    medians of the region's whole record, which is read again only in that case.
    """
    require_columns(wx, [region, "erc", "fm100", "tmmx_f", "rmin", "doy"], "weather")
    if len(spotting) != n_classes:
        raise ValueError(f"{len(spotting)} spotting rows for {n_classes} classes")
    probs = [i / n_classes for i in range(n_classes + 1)]
    limits = _limits(exact_quantiles(wx, [region], {"erc": "erc"}, probs).select(region, "q"))
    # i-th class from the top: limits n-i and n-i-1 (0-based edges of the ascending list).
    edges = limits.select(
        region, "q", F.explode(F.sequence(F.lit(1), F.lit(n_classes))).alias("class")
    ).select(
        region, "class",
        F.element_at("q", n_classes + 1 - F.col("class")).alias("lower"),
        F.element_at("q", n_classes + 2 - F.col("class")).alias("upper"),
    )
    spots = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in spotting])
    members = wx.join(limits, region).select(
        wx["*"],
        F.explode(
            F.filter(
                F.sequence(F.lit(1), F.lit(n_classes)),
                lambda c: (F.col("erc") >= F.element_at("q", n_classes + 1 - c))
                & (F.col("erc") <= F.element_at("q", n_classes + 2 - c)),
            )
        ).alias("class"),
    )
    inside = checkpoint(medians(members, [region, "class"], _dead_fuel()))
    empty = edges.join(inside, [region, "class"], "left_anti")
    if not empty.isEmpty():
        whole = wx.join(broadcast_if_small(empty.select(region).distinct()), region, "left_semi")
        record = medians(whole, [region], _dead_fuel())
        inside = inside.unionByName(empty.select(region, "class").join(record, region))
    r1 = lambda c: half_even(c, 1)
    joined = edges.join(inside, [region, "class"])
    spot = lambda i: F.element_at(F.element_at(spots, F.col("class")), i)
    return joined.select(
        region, "class", r1(F.col("lower")).alias("lower"), r1(F.col("upper")).alias("upper"),
        r1(_dead_medians()[0]).alias("fm1"), r1(_dead_medians()[1]).alias("fm10"),
        r1(F.col("fm100")).alias("fm100"),
        r1(nfdrs.calc_herb_fm("doy")).alias("fm_herb"),
        r1(nfdrs.calc_woody_fm("doy")).alias("fm_woody"),
        spot(1).alias("spot_dist"), spot(2).alias("spot_prob"), spot(3).alias("spot2"),
    )


def doy_in_window(doy: Column | str, center: Column | str, half_width: int = 14) -> Column:
    """Day of year within ± ``half_width`` days of ``center``, around the turn of the year."""
    d = F.col(doy) if isinstance(doy, str) else doy
    c = F.col(center) if isinstance(center, str) else center
    low, high = c - half_width, c + half_width
    return (
        F.when(low < 1, (d >= low + 366) | (d <= high))
        .when(high > 366, (d >= low) | (d <= high - 366))
        .otherwise(d.between(low, high))
    )


def _live_fuel(gsi: Column | None, doy: Column) -> tuple[Column, Column]:
    if gsi is None:
        return nfdrs.calc_herb_fm(doy), nfdrs.calc_woody_fm(doy)
    return nfdrs.calc_herb_fm_gsi(gsi), nfdrs.calc_woody_fm_gsi(gsi)


def _gsi(lat: Column | float) -> Column:
    return nfdrs.calc_gsi(
        "tmmn_f", nfdrs.calc_vpd_pa("tmmx_f", "rmin"), nfdrs.calc_daylength("doy", lat)
    )


def scenario_fuel_moistures(
    wx: DataFrame,
    scenarios: DataFrame,
    erc_percentile: float = 0.90,
    doy_window: int = 14,
    region: str = "pyrome",
    strict: bool = True,
) -> DataFrame:
    """Fuel moistures on high-danger days around a day of year, for many scenarios at once.

    ``scenarios`` is ``(region, scenario_doy[, lat])``. With ``lat`` and minimum temperature the
    live moistures follow the growing-season index, else the day of year. Scenarios without any
    record raise an error (``strict``) or are absent.
    """
    require_columns(scenarios, [region, "scenario_doy"], "scenarios")
    keys = [region, "scenario_doy"]
    by_gsi = "lat" in scenarios.columns and "tmmn_f" in wx.columns
    carried = [*keys, "lat"] if by_gsi else keys
    window = wx.join(broadcast_if_small(scenarios.select(*carried).distinct()), region).where(
        doy_in_window("doy", "scenario_doy", doy_window)
    )
    limit = _limits(
        exact_quantiles(window, keys, {"erc": "erc"}, [erc_percentile]).select(
            *keys, F.col("q")[0].alias("_limit")
        )
    )
    high = window.join(limit, keys).where(F.col("erc") >= F.col("_limit"))
    measures = {k: v for k, v in _dead_fuel().items() if k != "doy"}
    if by_gsi:
        measures["gsi"] = _gsi(F.col("lat"))
    mid = medians(high, keys, measures)
    herb, woody = _live_fuel(F.col("gsi") if by_gsi else None, F.col("scenario_doy"))
    out = mid.select(
        *keys,
        half_even(_dead_medians()[0], 1).alias("FM_1hr"),
        half_even(_dead_medians()[1], 1).alias("FM_10hr"),
        half_even(F.col("fm100"), 1).alias("FM_100hr"), half_even(herb, 1).alias("FM_herb"),
        half_even(woody, 1).alias("FM_woody"),
    )
    if strict and not scenarios.select(*keys).distinct().join(out, keys, "left_anti").isEmpty():
        raise ValueError("no weather records for a requested region and day of year")
    return out


def daily_weather_rows(
    wx: DataFrame,
    start_date: str,
    end_date: str,
    elevation_ft: int,
    region: str = "pyrome",
    precip_start: int = 600,
    precip_end: int = 1200,
) -> DataFrame:
    """Daily weather block of a conditioning period, sorted by region and date."""
    require_columns(wx, [region, "date", "tmmn_f", "tmmx_f", "rmax", "rmin", "pr"], "weather")
    whole = lambda c: F.rint(c).cast("int")
    pcp = F.greatest(F.lit(0), whole(F.col("pr") * 0.03937 * 100))
    return (
        wx.where(F.col("date").between(F.lit(start_date).cast("date"), F.lit(end_date).cast("date")))
        .withColumn("pcp", pcp)
        .select(
            region, "date", F.month("date").alias("month"), F.day("date").alias("day"), "pcp",
            F.lit(500).alias("min_t_hour"), F.lit(1400).alias("max_t_hour"),
            whole(F.col("tmmn_f")).alias("min_t"), whole(F.col("tmmx_f")).alias("max_t"),
            whole(F.col("rmax")).alias("max_rh"), whole(F.col("rmin")).alias("min_rh"),
            F.lit(int(elevation_ft)).alias("elev_ft"),
            F.when(F.col("pcp") > 0, precip_start).otherwise(0).alias("precip_start"),
            F.when(F.col("pcp") > 0, precip_end).otherwise(0).alias("precip_end"),
        )
        .orderBy(region, "date")
    )


def wind_percentiles(
    wx: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    erc_filter_pct: float | None = None,
    region: str = "pyrome",
) -> DataFrame:
    """Fire-season wind-speed percentiles, mean direction and number of days per region,
    optionally over days at or above an ERC percentile."""
    require_columns(wx, [region, "doy", "ws_mph", "wd_deg"], "weather")
    season = wx.where(F.col("doy").between(*SEASON_DOY)).where(
        F.col("ws_mph").isNotNull() & F.col("wd_deg").isNotNull()
    )
    if erc_filter_pct is not None and "erc" in wx.columns:
        limit = _limits(
            exact_quantiles(season, [region], {"erc": "erc"}, [erc_filter_pct]).select(
                region, F.col("q")[0].alias("_limit")
            )
        )
        # Regions without any ERC value keep all their days.
        season = season.join(limit, region, "left").where(
            F.col("_limit").isNull() | (F.col("erc") >= F.col("_limit"))
        )
    speeds = exact_quantiles(season, [region], {"ws": "ws_mph"}, list(percentiles))
    wd = F.radians("wd_deg")
    direction = season.groupBy(region).agg(
        F.avg(F.sin(wd)).alias("_s"), F.avg(F.cos(wd)).alias("_c"), F.count("*").alias("n_days")
    )
    cols = [
        half_even(F.col("q")[i], 1).alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)
    ]
    return speeds.select(region, *cols).join(
        direction.select(
            region,
            half_even(circular_mean_deg(F.col("_s"), F.col("_c")), 1).alias("wd_deg_mean"),
            "n_days",
        ),
        region,
    )


def scenario_cache(
    wx: DataFrame,
    percentiles: Sequence[float] = PERCENTILES,
    lat_deg: float | None = None,
    wind_direction: int = -2,
    wind_speed_source: str = "gridmet",
    region: str = "pyrome",
) -> DataFrame:
    """Fuel moistures and wind on days at or above each ERC percentile, per region.

    One row per (region, percentile). A day takes part in every percentile it reaches; the rows
    are expanded only to those.
    """
    require_columns(wx, [region, "doy", "erc", "fm100", "tmmx_f", "rmin"], "weather")
    probs = list(percentiles)
    season = wx.where(F.col("doy").between(*SEASON_DOY))
    limits = _limits(exact_quantiles(season, [region], {"erc": "erc"}, probs).select(region, "q"))
    level = F.filter(
        F.sequence(F.lit(1), F.lit(len(probs))),
        lambda i: F.col("erc") >= F.element_at("q", i),
    )
    high = season.join(limits, region).withColumn("_level", F.explode(level))
    measures = dict(_dead_fuel())
    has_wind = "ws_mph" in wx.columns and wind_speed_source == "gridmet"
    if has_wind:
        measures["ws"] = F.col("ws_mph")
    by_gsi = "tmmn_f" in wx.columns and lat_deg is not None
    if by_gsi:
        measures["gsi"] = _gsi(lat_deg)
    keys = [region, "_level"]
    mid = medians(high, keys, measures).join(limits, region)
    herb, woody = _live_fuel(F.col("gsi") if by_gsi else None, F.col("doy"))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("_level"))
    r1 = lambda c: half_even(c, 1)
    return mid.select(
        region, percentile_key(p).alias("key"), p.alias("percentile"),
        r1(_dead_medians()[0]).alias("FM_1hr"), r1(_dead_medians()[1]).alias("FM_10hr"),
        r1(F.col("fm100")).alias("FM_100hr"), r1(herb).alias("FM_herb"),
        r1(woody).alias("FM_woody"), F.lit(int(wind_direction)).alias("WIND_DIRECTION"),
        r1(F.element_at("q", F.col("_level"))).alias("erc_threshold"),
        half_even(F.col("doy"), 0).cast("int").alias("scenario_doy"),
        (r1(F.col("ws")) if has_wind else F.lit(None).cast("double")).alias("WIND_SPEED"),
    )


def scenario_cache_documents(cache: DataFrame, region: str = "pyrome") -> DataFrame:
    """Cache rows → one document per region: a map from percentile key to its scenario."""
    fields = ["FM_1hr", "FM_10hr", "FM_100hr", "FM_herb", "FM_woody", "WIND_DIRECTION",
              "erc_threshold", "scenario_doy", "WIND_SPEED"]
    return cache.groupBy(region).agg(
        F.array_sort(F.collect_list("percentile")).alias("percentiles"),
        F.first("WIND_DIRECTION").alias("wind_direction"),
        F.map_from_entries(F.collect_list(F.struct("key", F.struct(*fields)))).alias("scenarios"),
    )

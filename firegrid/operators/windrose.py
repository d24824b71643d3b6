"""Wind observations at fires and wind-rose tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import half_even
from ..functions.wind import (
    CALM_THRESHOLD_MPH, DIR_BREAKS_DEG, SPEED_BREAKS_MPH, known_direction_bin,
    speed_bin, wind_direction_deg, wind_speed_mph,
)
from ..schema import require_columns
from .spatial_join import nearest_grid_points

ARCHIVE_START_YEAR = 2016
FIRE_HOURS_UTC = (19, 20, 21, 22)
FIRE_HOURS_LOCAL = (13, 14, 15, 16)


def fire_hour_schedule(
    fires: DataFrame, n_days: int = 2, hours: Sequence[int] = FIRE_HOURS_UTC,
    start_year: int = ARCHIVE_START_YEAR,
) -> DataFrame:
    """Every (fire, date, hour) to sample: the first days of each fire of the archive period."""
    require_columns(fires, ["fire_id", "ignition_date"], "fires")
    return (
        fires.where(F.year("ignition_date") >= start_year)
        .withColumn("_day", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))))
        .withColumn("date", F.date_add(F.col("ignition_date").cast("date"), F.col("_day")))
        .withColumn("utc_hour", F.explode(F.array(*[F.lit(int(h)) for h in hours])))
        .drop("_day")
    )


def work_list(schedule: DataFrame) -> DataFrame:
    """Distinct (date, hour) pairs of a schedule."""
    return schedule.select("date", "utc_hour").distinct()


def winds_at_fires(
    fires: DataFrame,
    wind_grid: DataFrame,
    hours: Sequence[int] = FIRE_HOURS_UTC,
    n_days: int = 2,
    k: int = 1,
    bucket_deg: float = 0.25,
    start_year: int = ARCHIVE_START_YEAR,
) -> tuple[DataFrame, DataFrame]:
    """Wind at the ``k`` grid points nearest to each fire for its scheduled hours.

    ``fires`` is ``(fire_id, pyrome_id, ignition_date, lon, lat)``, ``wind_grid`` is ``(gid, lat,
    lon, valid_date, utc_hour, u, v)``. Returns the observations and the scheduled (date, hour)
    pairs that the grid lacks. The grid is first cut to the scheduled hours; the neighbours are
    found once per fire location, not once per hour.
    """
    require_columns(fires, ["fire_id", "pyrome_id", "ignition_date", "lon", "lat"], "fires")
    recent = fires.where(F.year("ignition_date") >= start_year)
    if recent.isEmpty():
        raise ValueError(f"no fire in {start_year} or later")
    schedule = fire_hour_schedule(recent, n_days, hours, start_year)
    wanted = work_list(schedule)
    present = wind_grid.select(F.col("valid_date").alias("date"), "utc_hour").distinct()
    skipped = wanted.join(present, ["date", "utc_hour"], "left_anti")
    lattice = wind_grid.select("gid", "lon", "lat").distinct()
    near = nearest_grid_points(
        recent.select("fire_id", "lon", "lat"), lattice, k, bucket_deg, point_id="fire_id"
    ).select("fire_id", "gid", "rank")
    hourly = (
        wind_grid.select(F.col("valid_date").alias("date"), "utc_hour", "gid", "u", "v")
        .join(wanted, ["date", "utc_hour"], "left_semi")
    )
    samples = schedule.join(near, "fire_id").join(hourly, ["date", "utc_hour", "gid"])
    obs = samples.select(
        "pyrome_id", "fire_id", "date", "utc_hour", "lon", "lat", "rank",
        wind_speed_mph("u", "v").alias("ws_mph"), wind_direction_deg("u", "v").alias("wd_deg"),
    )
    return obs, skipped


def wind_cells(
    obs: DataFrame,
    region: Sequence[str] = ("pyrome_id",),
    speed_breaks: Sequence[float] = SPEED_BREAKS_MPH,
    dir_breaks: Sequence[float] = DIR_BREAKS_DEG,
    calm: float = CALM_THRESHOLD_MPH,
    strict: bool = True,
) -> DataFrame:
    """Wind rose per region: share of non-calm observations per speed and direction bin.

    All bins are present. ``calm_pct`` refers to all observations. A region without any non-calm
    observation is an error (``strict``) or absent. A windy observation without a direction counts
    in the last direction bin; observations without a region are left out. Only the bin counts are
    shuffled.
    """
    region = list(region)
    require_columns(obs, [*region, "ws_mph", "wd_deg"], "observations")
    active = F.col("ws_mph") >= calm
    binned = obs.dropna(subset=region).select(
        *region,
        F.when(active, speed_bin("ws_mph", speed_breaks)).alias("speed_bin"),
        F.when(active, known_direction_bin("wd_deg", dir_breaks)).alias("dir_bin"),
    )
    counts = binned.groupBy(*region, "speed_bin", "dir_bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*region).agg(
        F.sum("n").alias("n_obs"),
        F.coalesce(F.sum(F.when(F.col("speed_bin").isNull(), F.col("n"))), F.lit(0)).alias("_calm"),
    )
    if strict:
        windy = F.when(
            F.col("n_obs") == F.col("_calm"),
            F.raise_error(F.lit("all observations of a region are calm")).cast("bigint"),
        ).otherwise(F.col("n_obs"))
        totals = totals.withColumn("n_obs", windy)
    else:
        totals = totals.where(F.col("n_obs") > F.col("_calm"))
    frame = totals.withColumn(
        "speed_bin", F.explode(F.sequence(F.lit(0), F.lit(len(speed_breaks) - 1)))
    ).withColumn("dir_bin", F.explode(F.sequence(F.lit(0), F.lit(len(dir_breaks) - 1))))
    return frame.join(counts, [*region, "speed_bin", "dir_bin"], "left").select(
        *region, "speed_bin", "dir_bin",
        F.element_at(F.array(*[F.lit(float(b)) for b in speed_breaks]), F.col("speed_bin") + 1)
        .alias("speed_upper"),
        F.element_at(F.array(*[F.lit(float(b)) for b in dir_breaks]), F.col("dir_bin") + 1)
        .alias("dir_upper"),
        (F.coalesce("n", F.lit(0)) / (F.col("n_obs") - F.col("_calm")) * 100.0).alias("pct"),
        (F.col("_calm") / F.col("n_obs") * 100.0).alias("calm_pct"),
        "n_obs",
        (F.col("n_obs") - F.col("_calm")).alias("n_noncalm"),
    )


def region_wind_roses(
    obs: DataFrame, region: str = "pyrome_id", min_obs_warn: int = 100, **kw
) -> DataFrame:
    """Wind rose per region with the covered years and a flag for sparse regions."""
    span = obs.groupBy(region).agg(
        F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year")
    )
    return (
        wind_cells(obs, [region], **kw)
        .join(span, region)
        .withColumn("sparse", (F.lit(min_obs_warn) > 0) & (F.col("n_noncalm") < min_obs_warn))
    )


def wind_rose_documents(roses: DataFrame, region: str = "pyrome_id") -> DataFrame:
    """One document per region: bins, the speed x direction matrix, calm share and coverage.
    A matrix has as many values as bins (48)."""
    rows = roses.groupBy(
        region, "speed_bin", "speed_upper", "calm_pct", "n_obs", "first_year", "last_year"
    ).agg(F.array_sort(F.collect_list(F.struct("dir_bin", "dir_upper", "pct"))).alias("_d"))
    docs = rows.groupBy(region, "calm_pct", "n_obs", "first_year", "last_year").agg(
        F.array_sort(F.collect_list(F.struct("speed_bin", "speed_upper", "_d"))).alias("_s")
    )
    return docs.select(
        region,
        F.size("_s").alias("NumWindSpeeds"),
        F.size(F.col("_s")[0]["_d"]).alias("NumWindDirs"),
        F.transform("_s", lambda s: s["speed_upper"]).alias("WindSpeedBreaks_mph"),
        F.transform(F.col("_s")[0]["_d"], lambda d: d["dir_upper"]).alias("WindDirBreaks_deg"),
        F.transform("_s", lambda s: F.transform(s["_d"], lambda d: d["pct"])).alias(
            "WindCellValues"
        ),
        half_even(F.col("calm_pct"), 4).alias("CalmValue"),
        F.col("n_obs").alias("n_observations"),
        F.concat_ws("-", F.col("first_year").cast("string"), F.col("last_year").cast("string"))
        .alias("years_covered"),
    )


def hourly_wind_rows(
    obs: DataFrame,
    start_date: str,
    end_date: str,
    hours: Sequence[int] = FIRE_HOURS_LOCAL,
    cloud_cover: int = 0,
    utc_offset_hours: int = 0,
    strict: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Hourly wind block of a conditioning period, sorted by time.

    The time comes from ``datetime``, or ``date`` plus ``hour``, or ``date`` plus ``utc_hour``
    shifted by ``utc_offset_hours``. ``keys`` (e.g. the region) are carried along.
    """
    hours_later = lambda h: F.make_dt_interval(hours=h)
    day = F.col("date").cast("timestamp")
    if "datetime" in obs.columns:
        when = F.col("datetime").cast("timestamp")
    elif {"date", "hour"} <= set(obs.columns):
        when = day + hours_later(F.col("hour"))
    elif {"date", "utc_hour"} <= set(obs.columns):
        when = day + hours_later(F.col("utc_hour") + utc_offset_hours)
    else:
        require_columns(obs, ["datetime"], "observations")
    begin = F.lit(start_date).cast("timestamp")
    end = F.lit(end_date).cast("timestamp") + F.make_dt_interval(hours=F.lit(23))
    whole = lambda c: F.rint(c).cast("int")
    cloud = whole(F.col("cloud_cover")) if "cloud_cover" in obs.columns else F.lit(int(cloud_cover))
    rows = (
        obs.withColumn("_t", when)
        .where(F.col("_t").between(begin, end) & F.hour("_t").isin([int(h) for h in hours]))
        .select(
            *keys, "_t", F.month("_t").alias("month"), F.day("_t").alias("day"),
            (F.hour("_t") * 100).alias("hhmm"), whole(F.col("ws_mph")).alias("speed"),
            whole(F.col("wd_deg")).alias("direction"), cloud.alias("cloud_cover"),
        )
    )
    if strict and rows.isEmpty():
        raise ValueError(f"no records for hours {list(hours)} in {start_date} to {end_date}")
    return rows.orderBy(*keys, "_t", "speed", "direction").withColumnRenamed("_t", "time")

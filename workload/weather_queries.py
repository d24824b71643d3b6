"""Climatology, wind and weather-bundle operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import climatology, windrose
from firegrid.plans.weather_bundle import weather_bundle
from firegrid.sources import documents, tables as src

from .registry import query, r6
from .scalar_queries import EMC, GSI, DECL, B, clip_sql

SEASON = """
SELECT s.pyrome, s.year, s.dos, coalesce(d.erc, m.erc) AS erc, d.erc IS NULL AS filled FROM (
 SELECT pyrome, year, CAST(i AS INT) AS dos FROM (SELECT DISTINCT pyrome, year FROM {daily}), range(1, 215) r(i)) s
LEFT JOIN {daily} d USING (pyrome, year, dos)
LEFT JOIN (SELECT pyrome, dos, median(erc) AS erc FROM {daily} GROUP BY ALL) m USING (pyrome, dos)"""
DAILY = """
SELECT pyrome, year, dos, avg(erc) AS erc FROM (SELECT *, CAST(date_diff('day', make_date(year, 4, 1), date) + 1 AS INT) AS dos FROM {wx})
WHERE dos BETWEEN 1 AND 214 GROUP BY ALL"""
DEAD = f"""SELECT *, 1.03 * greatest(0, {EMC}) AS fm1, 1.28 * greatest(0, {EMC}) AS fm10 FROM {{wx}}"""


def herb_sql(doy: str) -> str:
    return f"(250 + {clip_sql(f'({doy} - 91) / 159.0::DOUBLE', 0, 1)} * -220)"


def woody_sql(doy: str) -> str:
    return clip_sql(f"130 + 70 * cos(pi() * ({doy} - 152) / 122)", 50, 200)


def e1(x: str) -> str:
    return f"round_even({x}, 1)::DOUBLE"


@query(
    "S7 F1",
    """SELECT pyrome, CAST(date AS STRING) AS date, CAST(year(date) AS INT) AS year, CAST(dayofyear(date) AS INT) AS doy,
  erc, fm100, fm1000, rmin, rmax, pr, round(tmmx * 9 / 5 - 459.67::DOUBLE, 6) AS tmmx_f, round(tmmn * 9 / 5 - 459.67::DOUBLE, 6) AS tmmn_f,
  round(vs * 2.23694::DOUBLE, 6) AS ws_mph, th AS wd_deg
FROM (SELECT * REPLACE (CASE WHEN rmax = 61 THEN NULL ELSE rmax END AS rmax) FROM {wx_raw}) WHERE erc IS NOT NULL""",
)
def daily_climatology(t):
    """Raw text columns with padded upper-case names and some values that are not numbers."""
    raw = t.wx_raw
    text = raw.select(
        *[
            F.when(F.col(c) == 61, F.lit("n/a")).otherwise(F.col(c).cast("string")).alias(f" {c.upper()} ")
            if c == "rmax"
            else F.col(c).cast("string").alias(f" {c.upper()} ")
            for c in raw.columns
        ]
    )
    out = src.normalise_climatology(text)
    return r6(out, "tmmx_f", "tmmn_f", "ws_mph").withColumn("date", F.col("date").cast("string"))


@query(
    "S7 A24",
    """SELECT count(erc) AS n_rows, count(*) - count(erc) AS n_dropped, count(DISTINCT pyrome) AS n_pyromes,
 CAST(min(year(date)) AS INT) AS first_year, CAST(max(year(date)) AS INT) AS last_year FROM {wx_raw}""",
)
def climatology_report(t):
    return src.climatology_report(t.wx_raw.withColumn("date", F.col("date").cast("string")))


@query("C1 J9", "SELECT pyrome, year, dos, round(erc, 6) AS erc, filled FROM {season}", daily=DAILY, season=SEASON)
def season_erc(t):
    return r6(climatology.season_erc(t.wx))


@query(
    "C1 S11",
    "SELECT pyrome, year, len(v) AS n_days, round(list_sum(v), 6) AS total, n_years FROM (SELECT pyrome, year, list(erc) AS v, count(*) OVER (PARTITION BY pyrome) AS n_years FROM {season} GROUP BY pyrome, year)",
    daily=DAILY, season=SEASON,
)
def season_matrix(t):
    m = climatology.season_matrix(climatology.season_erc(t.wx), n_years=7)
    rows = m.select("pyrome", F.size("years").cast("bigint").alias("n_years"), F.explode(F.arrays_zip("years", "erc")).alias("_r"))
    total = F.aggregate("_r.erc", F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return rows.select(
        "pyrome", F.col("_r.years").alias("year"), F.size("_r.erc").cast("bigint").alias("n_days"),
        F.round(total, 6).alias("total"), "n_years",
    )


@query(
    "C2",
    """SELECT pyrome, dos, round(avg(erc), 6) AS erc_avg, round(stddev_samp(erc), 6) AS erc_std
FROM {season} GROUP BY ALL""",
    daily=DAILY, season=SEASON,
)
def season_statistics(t):
    return r6(climatology.erc_stats(climatology.season_erc(t.wx), digits=13))


@query(
    "C4",
    """SELECT pyrome, dos, CAST(round_even(median(erc), 0) AS INT) AS erc FROM {season} WHERE dos BETWEEN 91 AND 169 GROUP BY ALL""",
    daily=DAILY, season=SEASON,
)
def current_season(t):
    return climatology.current_erc(climatology.season_erc(t.wx), 91)


@query(
    "C3 J8 F7 F9",
    f"""SELECT pyrome, CAST(class AS INT) AS class, {e1('lower')} AS lower, {e1('upper')} AS upper, {e1('m1')} AS fm1, {e1('m10')} AS fm10,
 {e1('m100')} AS fm100, {e1(herb_sql('mdoy'))} AS fm_herb, {e1(woody_sql('mdoy'))} AS fm_woody,
 (420 - 60 * class)::DOUBLE AS spot_dist, [0.15, 0.10, 0.05, 0.01, 0.0][class]::DOUBLE AS spot_prob, 0.0::DOUBLE AS spot2
FROM (SELECT pyrome, class, lower, upper, median(fm1) AS m1, median(fm10) AS m10, median(fm100) AS m100, median(doy) AS mdoy
 FROM {{dead}} JOIN (SELECT pyrome, class, q[6 - class] AS lower, q[7 - class] AS upper FROM (
   SELECT pyrome, quantile_cont(erc, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM {{wx}} GROUP BY pyrome), range(1, 6) r(class)) USING (pyrome)
 WHERE erc >= lower AND erc <= upper GROUP BY ALL)""",
    dead=DEAD,
)
def erc_class_table(t):
    return climatology.erc_classes(t.wx)


SCEN = """
SELECT CAST(n_nationkey % 8 AS STRING) AS pyrome, CAST(1 + (n_nationkey * 15) % 366 AS INT) AS scenario_doy,
  CAST(35 + n_nationkey % 8 AS DOUBLE) AS lat FROM {nation}"""


def scenario_days(t):
    n = F.col("n_nationkey")
    return t.nation.select(
        (n % 8).cast("string").alias("pyrome"), (1 + (n * 15) % 366).cast("int").alias("scenario_doy"),
        (35 + n % 8).cast("double").alias("lat"),
    )


WINDOW = """
SELECT d.*, scenario_doy, lat FROM {dead} d JOIN {scen} USING (pyrome) WHERE CASE
 WHEN scenario_doy - 14 < 1 THEN doy >= scenario_doy - 14 + 366 OR doy <= scenario_doy + 14
 WHEN scenario_doy + 14 > 366 THEN doy >= scenario_doy - 14 OR doy <= scenario_doy + 14 - 366
 ELSE doy BETWEEN scenario_doy - 14 AND scenario_doy + 14 END"""
HIGH = """
SELECT w.* FROM {window} w JOIN (SELECT pyrome, scenario_doy, quantile_cont(erc, 0.9) AS lim FROM {window} GROUP BY ALL) USING (pyrome, scenario_doy)
WHERE erc >= lim"""


@query(
    "C5 J9",
    f"""SELECT pyrome, scenario_doy, {e1('median(fm1)')} AS FM_1hr, {e1('median(fm10)')} AS FM_10hr, {e1('median(fm100)')} AS FM_100hr,
 {e1(herb_sql('scenario_doy'))} AS FM_herb, {e1(woody_sql('scenario_doy'))} AS FM_woody FROM {{high}} GROUP BY pyrome, scenario_doy""",
    dead=DEAD, scen=SCEN, window=WINDOW, high=HIGH,
)
def scenario_fuel_moistures(t):
    return climatology.scenario_fuel_moistures(t.wx, scenario_days(t).drop("lat"))


VPD = "greatest(0, 610.78 * exp(17.2694 * ((tmmx_f - 32) * 5 / 9) / ((tmmx_f - 32) * 5 / 9 + 237.3)) * (1 - rmin / 100))"


def daylength_sql(lat: str) -> str:
    return f"2 * degrees(acos({clip_sql(f'-tan(radians({lat})) * tan({DECL})', -1, 1)})) / 15"


@query(
    "C5 F6 F8",
    f"""SELECT pyrome, scenario_doy, {e1('median(fm1)')} AS FM_1hr, {e1('median(fm10)')} AS FM_10hr, {e1('median(fm100)')} AS FM_100hr,
 {e1(f"30 + {clip_sql('(median(gsi) - 0.5) / 0.5', 0, 1)} * 220")} AS FM_herb,
 {e1(f"60 + {clip_sql('(median(gsi) - 0.5) / 0.5', 0, 1)} * 140")} AS FM_woody
FROM (SELECT *, {GSI} AS gsi FROM (SELECT *, {VPD} AS vpd, {daylength_sql('lat')} AS dl FROM {{high}})) GROUP BY pyrome, scenario_doy""",
    dead=DEAD, scen=SCEN, window=WINDOW, high=HIGH,
)
def scenario_fuel_moistures_gsi(t):
    return climatology.scenario_fuel_moistures(t.wx, scenario_days(t))


@query(
    "C6 K1",
    """SELECT pyrome, CAST(date AS STRING) AS date, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day, pcp,
 500 AS min_t_hour, 1400 AS max_t_hour, CAST(round_even(tmmn_f, 0) AS INT) AS min_t, CAST(round_even(tmmx_f, 0) AS INT) AS max_t,
 CAST(round_even(rmax, 0) AS INT) AS max_rh, CAST(round_even(rmin, 0) AS INT) AS min_rh, 7000 AS elev_ft,
 CASE WHEN pcp > 0 THEN 600 ELSE 0 END AS precip_start, CASE WHEN pcp > 0 THEN 1200 ELSE 0 END AS precip_end
FROM (SELECT *, greatest(0, CAST(round_even(pr * 0.03937::DOUBLE * 100, 0) AS INT)) AS pcp FROM {wx})
WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-08-31'""",
)
def conditioning_weather(t):
    rows = climatology.daily_weather_rows(t.wx, "1998-06-01", "1998-08-31", 7000)
    return rows.withColumn("date", F.col("date").cast("string"))


WIND_SEASON = """
SELECT w.* FROM {wx} w JOIN (SELECT pyrome, quantile_cont(erc, 0.9) AS lim FROM {wx} WHERE doy BETWEEN 91 AND 304 GROUP BY pyrome) USING (pyrome)
WHERE doy BETWEEN 91 AND 304 AND erc >= lim"""


@query(
    "C7 F34",
    f"""SELECT pyrome, {e1('quantile_cont(ws_mph, 0.25)')} AS p25, {e1('quantile_cont(ws_mph, 0.5)')} AS p50, {e1('quantile_cont(ws_mph, 0.75)')} AS p75,
 {e1('quantile_cont(ws_mph, 0.9)')} AS p90, {e1('quantile_cont(ws_mph, 0.97)')} AS p97,
 {e1('(degrees(atan2(avg(sin(radians(wd_deg))), avg(cos(radians(wd_deg))))) + 360) % 360')} AS wd_deg_mean, count(*) AS n_days
FROM {{wind_season}} GROUP BY pyrome""",
    wind_season=WIND_SEASON,
)
def wind_percentiles(t):
    return climatology.wind_percentiles(t.wx, erc_filter_pct=0.9)


@query(
    "C8 F34",
    f"""SELECT pyrome, concat('p', CAST(round(p * 100) AS INT)) AS key, p AS percentile, {e1('median(fm1)')} AS FM_1hr, {e1('median(fm10)')} AS FM_10hr,
 {e1('median(fm100)')} AS FM_100hr, {e1(herb_sql('median(doy)'))} AS FM_herb, {e1(woody_sql('median(doy)'))} AS FM_woody,
 -2 AS WIND_DIRECTION, {e1('any_value(lim)')} AS erc_threshold, CAST(round_even(median(doy), 0) AS INT) AS scenario_doy,
 {e1('median(ws_mph)')} AS WIND_SPEED
FROM {{dead}} JOIN (SELECT pyrome, p, q[i] AS lim FROM (SELECT pyrome, quantile_cont(erc, [0.25, 0.5, 0.75, 0.9, 0.97]) AS q
  FROM {{wx}} WHERE doy BETWEEN 91 AND 304 GROUP BY pyrome), (VALUES (1, 0.25::DOUBLE), (2, 0.5), (3, 0.75), (4, 0.9), (5, 0.97)) v(i, p)) USING (pyrome)
WHERE doy BETWEEN 91 AND 304 AND erc >= lim GROUP BY pyrome, p""",
    dead=DEAD,
)
def scenario_cache(t):
    return climatology.scenario_cache(t.wx)


@query(
    "C8 S11",
    f"""SELECT pyrome, 5 AS n, round(sum(t), 4) AS total FROM (SELECT pyrome, p, {e1('any_value(lim)')} AS t FROM {{wx}}
 JOIN (SELECT pyrome, p, q[i] AS lim FROM (SELECT pyrome, quantile_cont(erc, [0.25, 0.5, 0.75, 0.9, 0.97]) AS q
  FROM {{wx}} WHERE doy BETWEEN 91 AND 304 GROUP BY pyrome), (VALUES (1, 0.25::DOUBLE), (2, 0.5), (3, 0.75), (4, 0.9), (5, 0.97)) v(i, p)) USING (pyrome)
 GROUP BY pyrome, p) GROUP BY pyrome""",
)
def scenario_cache_documents(t):
    docs = climatology.scenario_cache_documents(climatology.scenario_cache(t.wx))
    total = F.aggregate(F.map_values("scenarios"), F.lit(0.0), lambda a, s: a + s["erc_threshold"])
    return docs.select("pyrome", F.size("percentiles").alias("n"), F.round(total, 4).alias("total"))


SCHEDULE = """
SELECT fire_id, CAST(ignition_date + CAST(d AS INT) AS DATE) AS date, CAST(h AS INT) AS utc_hour FROM {fires},
 range(2) a(d), (VALUES (19), (20), (21), (22)) b(h) WHERE year(ignition_date) >= 2016"""


@query(
    "C9",
    "SELECT fire_id, CAST(date AS STRING) AS date, utc_hour FROM {schedule}",
    schedule=SCHEDULE,
)
def fire_hour_schedule(t):
    out = windrose.fire_hour_schedule(t.fires)
    return out.select("fire_id", F.col("date").cast("string").alias("date"), "utc_hour")


NEAR1 = """
SELECT fire_id, arg_min(gid, (d, gid)) AS gid FROM (SELECT f.fire_id, l.gid, sqrt((f.lon - (l.lon - 360)) ** 2 + (f.lat - l.lat) ** 2) AS d
 FROM {fires} f JOIN {lattice} l ON l.lon - 360 BETWEEN f.lon - 0.1 AND f.lon + 0.1 AND l.lat BETWEEN f.lat - 0.1 AND f.lat + 0.1) GROUP BY fire_id"""


@query(
    "C10 J12",
    """SELECT fire_id, pyrome_id, CAST(date AS STRING) AS date, utc_hour, round(sqrt(u * u + v * v) * 2.23694::DOUBLE, 6) AS ws_mph,
 round((degrees(atan2(-u, -v)) + 360) % 360, 6) AS wd_deg
FROM {schedule} s JOIN {fires} USING (fire_id) JOIN {near1} USING (fire_id)
JOIN {wind_grid} w ON w.gid = near1.gid AND w.valid_date = s.date AND w.utc_hour = s.utc_hour""".replace(
        "{near1} USING", "{near1} near1 USING").replace("CAST(date", "CAST(s.date").replace(", utc_hour,", ", s.utc_hour,"),
    schedule=SCHEDULE, near1=NEAR1,
)
def winds_at_fires(t):
    obs, _ = windrose.winds_at_fires(t.fires, t.wind_grid, bucket_deg=0.1)
    return r6(obs.select(
        "fire_id", "pyrome_id", F.col("date").cast("string").alias("date"), "utc_hour", "ws_mph", "wd_deg"
    ))


@query(
    "C10 A25",
    """SELECT DISTINCT CAST(date AS STRING) AS date, utc_hour FROM {schedule}
WHERE (date, utc_hour) NOT IN (SELECT (valid_date, utc_hour) FROM {wind_grid})""",
    schedule=SCHEDULE,
)
def skipped_fire_hours(t):
    _, skipped = windrose.winds_at_fires(t.fires, t.wind_grid, bucket_deg=0.1)
    return skipped.withColumn("date", F.col("date").cast("string"))


ROSE = """
SELECT pyrome_id, CAST(s AS INT) AS speed_bin, CAST(d AS INT) AS dir_bin, (s + 1) * 5.0::DOUBLE AS speed_upper, (d + 1) * 45.0::DOUBLE AS dir_upper,
 coalesce(n, 0) / (n_obs - calm)::DOUBLE * 100 AS pct, calm / n_obs::DOUBLE * 100 AS calm_pct, n_obs, n_obs - calm AS n_noncalm
FROM (SELECT pyrome_id, count(*) AS n_obs, count(*) FILTER (WHERE ws_mph < 2) AS calm FROM {obs} GROUP BY ALL) o CROSS JOIN range(6) a(s) CROSS JOIN range(8) b(d)
LEFT JOIN (SELECT pyrome_id, greatest(0, least(5, ceil(ws_mph / 5) - 1)) AS s, CASE WHEN wd_deg = 0 THEN 7 ELSE ceil(wd_deg / 45) - 1 END AS d, count(*) AS n
 FROM {obs} WHERE ws_mph >= 2 GROUP BY ALL) USING (pyrome_id, s, d)"""


@query(
    "C11 F10",
    "SELECT pyrome_id, speed_bin, dir_bin, speed_upper, dir_upper, round(pct, 6) AS pct, round(calm_pct, 6) AS calm_pct, n_obs, n_noncalm FROM {rose}",
    rose=ROSE,
)
def wind_rose(t):
    return r6(windrose.wind_cells(t.obs))


# Observations with missing directions and regions.
OBS_GAPS = """SELECT CASE WHEN utc_hour % 5 = 0 THEN NULL ELSE pyrome_id END AS pyrome_id, ws_mph,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE wd_deg END AS wd_deg FROM {obs}"""


@query(
    "C11",
    """SELECT pyrome_id, speed_bin, dir_bin, round(pct, 6) AS pct, n_obs, n_noncalm FROM {rose_gaps}""",
    obs_gaps=OBS_GAPS,
    rose_gaps=ROSE.replace("{obs} GROUP", "{obs_gaps} WHERE pyrome_id IS NOT NULL GROUP")
    .replace("{obs} WHERE", "{obs_gaps} WHERE").replace("WHEN wd_deg = 0 THEN", "WHEN wd_deg IS NULL OR wd_deg = 0 THEN"),
)
def wind_rose_gaps(t):
    region = F.when(F.col("utc_hour") % 5 != 0, F.col("pyrome_id"))
    direction = F.when(F.col("event_id") % 4 != 0, F.col("wd_deg"))
    obs = t.obs.withColumns({"pyrome_id": region, "wd_deg": direction})
    return r6(windrose.wind_cells(obs).select("pyrome_id", "speed_bin", "dir_bin", "pct", "n_obs", "n_noncalm"))


@query(
    "C12",
    """SELECT pyrome_id, speed_bin, dir_bin, round(pct, 6) AS pct, n_noncalm, first_year, last_year, n_noncalm < 100 AS sparse
FROM {rose} JOIN (SELECT pyrome_id, CAST(min(year(date)) AS INT) AS first_year, CAST(max(year(date)) AS INT) AS last_year FROM {obs} GROUP BY ALL) USING (pyrome_id)""",
    rose=ROSE,
)
def region_wind_roses(t):
    out = windrose.region_wind_roses(t.obs)
    return r6(out.select(
        "pyrome_id", "speed_bin", "dir_bin", "pct", "n_noncalm", "first_year", "last_year", "sparse"
    ))


@query(
    "C14 K1",
    """SELECT CAST(date + INTERVAL (utc_hour) HOUR AS STRING) AS time, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
 utc_hour * 100 AS hhmm, CAST(round_even(ws_mph, 0) AS INT) AS speed, CAST(wd_deg AS INT) AS direction, 0 AS cloud_cover
FROM {obs} WHERE date BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' AND utc_hour IN (13, 14, 15, 16)""",
)
def conditioning_wind(t):
    rows = windrose.hourly_wind_rows(t.obs.drop("ts"), "2024-01-02", "2024-01-20")
    return rows.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query(
    "C13",
    """SELECT pyrome, round_even(calm_pct, 4)::DOUBLE AS calm_value, n_years, 214 AS n_days, 5 AS n_classes, 79 AS n_current, 6 AS n_speeds
FROM (SELECT DISTINCT pyrome_id AS pyrome, calm_pct FROM {rose}) JOIN (SELECT pyrome, CAST(count(DISTINCT year) AS INT) AS n_years FROM {daily} GROUP BY pyrome) USING (pyrome)""",
    rose=ROSE, daily=DAILY,
)
def weather_bundles(t):
    b = weather_bundle(t.wx, t.obs)
    return b.select(
        "pyrome", "calm_value", F.size("erc_historic").alias("n_years"), F.size("erc_avg").alias("n_days"),
        F.size("erc_classes").alias("n_classes"), F.size("current_erc").alias("n_current"),
        F.size("wind_cells").alias("n_speeds"),
    )


def fx(x: str, d: int) -> str:
    return f"coalesce(printf('%.{d}f', round_even({x}, {d})::DOUBLE), 'nan')"


_HEAD = (
    "FSPRO-Inputs-File-Version-4", "Dimension: 2", "Resolution: 90.0", "Duration: 7", "NumFires: 1000", "MaxLag: 30",
    "PolyDegree: 9", "ThreadsPerFire: 1", "UseCustomFuels: 0", "SPOTTING_SEED: 617327", "CROWN_FIRE_METHOD: Finney",
)
_FIXED = {
    **dict(enumerate(_HEAD)), 12: "NumWindDirs: 8", 13: "45 90 135 180 225 270 315 360", 14: "NumWindSpeeds: 6",
    15: "5 10 15 20 25 30", 16: "WindCellValues:", 23: "NumERCClasses: 5", 30: "NumWxPerYear: 214", 31: "HistoricERCValues: ",
}
_TAIL = ("AvgERCValues: ", None, "StdDevERCValues:", None, "NumWxCurrYear: 79", "CurrentERCValues: ", None, "NumForecast: 0",
         "BarrierFill: 0", "SavePerimeters: 1", None)
STATS = """
SELECT pyrome, dos, round_even(avg(erc), 2)::DOUBLE AS m, round_even(stddev_samp(erc), 2)::DOUBLE AS s, round_even(median(erc), 0) AS c
FROM {season} GROUP BY ALL"""
CLASSES = f"""
SELECT pyrome, CAST(class AS INT) AS class, {e1('lower')} AS lower, {e1('upper')} AS upper, {e1('m1')} AS fm1, {e1('m10')} AS fm10,
 {e1('m100')} AS fm100, {e1(herb_sql('mdoy'))} AS fm_herb, {e1(woody_sql('mdoy'))} AS fm_woody
FROM (SELECT pyrome, class, lower, upper, median(fm1) AS m1, median(fm10) AS m10, median(fm100) AS m100, median(doy) AS mdoy
 FROM {{dead}} JOIN (SELECT pyrome, class, q[6 - class] AS lower, q[7 - class] AS upper FROM (
   SELECT pyrome, quantile_cont(erc, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM {{wx}} GROUP BY pyrome), range(1, 6) r(class)) USING (pyrome)
 WHERE erc >= lower AND erc <= upper GROUP BY ALL)"""
DOCS = (
    """
SELECT p.pyrome, y.n AS years, f.line_no, f.line FROM (SELECT DISTINCT pyrome FROM {season}) p JOIN {n_years} y USING (pyrome),
 (VALUES """ + ", ".join(f"({i}, '{v}')" for i, v in _FIXED.items()) + f""") f(line_no, line)
UNION ALL SELECT DISTINCT pyrome_id, NULL, 11, concat('CalmValue: ', {fx('round_even(calm_pct, 4)', 2)}) FROM {{rose}}
UNION ALL SELECT pyrome_id, NULL, 17 + speed_bin, string_agg({fx('pct', 2)}, ' ' ORDER BY dir_bin) FROM {{rose}} GROUP BY pyrome_id, speed_bin
UNION ALL SELECT pyrome, NULL, 23 + class, concat_ws(' ', {fx('lower', 0)}, {fx('upper', 0)}, {fx('fm1', 1)}, {fx('fm10', 1)}, {fx('fm100', 1)},
  {fx('fm_herb', 1)}, {fx('fm_woody', 1)}, 420 - 60 * class, ['0.15', '0.10', '0.05', '0.01', '0.00'][class], '0') FROM {{classes}}
UNION ALL SELECT pyrome, NULL, 29, concat('NumERCYears: ', n) FROM {{n_years}}
UNION ALL SELECT pyrome, NULL, 31 + row_number() OVER (PARTITION BY pyrome ORDER BY year), line FROM (
  SELECT pyrome, year, string_agg({fx('erc', 0)}, ' ' ORDER BY dos) AS line FROM {{season}} GROUP BY pyrome, year)
UNION ALL SELECT pyrome, NULL, 32 + n + k, line FROM {{n_years}}, (VALUES """
    + ", ".join(f"({k}, '{v}')" for k, v in enumerate(_TAIL) if v is not None) + f""") f(k, line)
UNION ALL SELECT pyrome, NULL, 33 + n, string_agg({fx('m', 1)}, ' ' ORDER BY dos) FROM {{stats}} JOIN {{n_years}} USING (pyrome) GROUP BY pyrome, n
UNION ALL SELECT pyrome, NULL, 35 + n, string_agg({fx('s', 2)}, ' ' ORDER BY dos) FROM {{stats}} JOIN {{n_years}} USING (pyrome) GROUP BY pyrome, n
UNION ALL SELECT pyrome, NULL, 38 + n, string_agg({fx('c', 0)}, ' ' ORDER BY dos) FROM {{stats}} JOIN {{n_years}} USING (pyrome) WHERE dos BETWEEN 91 AND 169 GROUP BY pyrome, n"""
)
DOC_VIEWS = {
    "daily": DAILY, "season": SEASON, "dead": DEAD, "rose": ROSE, "stats": STATS, "classes": CLASSES, "docs": DOCS,
    "n_years": "SELECT pyrome, count(DISTINCT year) AS n FROM {daily} GROUP BY pyrome",
}


@query(
    "S15 S16",
    """SELECT pyrome, CAST(line_no AS INT) AS line_no, line FROM {docs} UNION ALL
SELECT pyrome, CAST(42 + n AS INT), 'IgnitionFile: ignition.shp' FROM {n_years}""",
    **DOC_VIEWS,
)
def probability_run_documents(t):
    return documents.paired_lines(weather_bundle(t.wx, t.obs), "ignition.shp")

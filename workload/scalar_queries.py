"""Scalar functions over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions import albers, bins, names, nfdrs, thin, wind
from firegrid.functions import sdi_classes as sc

from .registry import query, r6

EMC = """CASE WHEN rmin < 10 THEN 0.03229 + 0.281073 * rmin - 0.000578 * tmmx_f * rmin
  WHEN rmin < 50 THEN 2.22749 + 0.160107 * rmin - 0.014784 * tmmx_f
  ELSE 21.0606 + 0.005565 * rmin * rmin - 0.00035 * tmmx_f * rmin - 0.483199 * rmin END"""
B = "(2 * pi() * (doy - 1) / 365)"
DECL = f"""(0.006918 - 0.399912 * cos({B}) + 0.070257 * sin({B}) - 0.006758 * cos(2 * {B})
  + 0.000907 * sin(2 * {B}) - 0.002697 * cos(3 * {B}) + 0.00148 * sin(3 * {B}))"""


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


GSI = f"""{clip_sql('(tmmn_f - 28.4) / 12.6', 0, 1)} * {clip_sql('(4100 - vpd) / 3200', 0, 1)}
  * {clip_sql('dl - 10', 0, 1)}"""


@query(
    "F1 F2 F3",
    f"""SELECT tmmx AS tmmx_k, rmin, round(tmmx_f, 9) AS tmmx_f, round(greatest(0, emc), 9) AS emc,
  round(1.03 * greatest(0, emc), 9) AS fm1, round(1.28 * greatest(0, emc), 9) AS fm10, n
FROM (SELECT tmmx, rmin, tmmx_f, {EMC} AS emc, n FROM (
  SELECT tmmx, rmin, tmmx * 9 / 5 - 459.67 AS tmmx_f, count(*) AS n FROM {{wx_raw}} GROUP BY ALL))""",
)
def dead_fuel_moisture(t):
    f = nfdrs.kelvin_to_fahrenheit("tmmx_k")
    grouped = t.wx_raw.groupBy(F.col("tmmx").alias("tmmx_k"), "rmin").agg(F.count("*").alias("n"))
    return r6(
        grouped.withColumn("tmmx_f", f).withColumns(
            {
                "emc": nfdrs.calc_emc("tmmx_f", "rmin"),
                "fm1": nfdrs.calc_1hr_fm("tmmx_f", "rmin"),
                "fm10": nfdrs.calc_10hr_fm("tmmx_f", "rmin"),
            }
        ),
        digits=9,
    )


@query(
    "F4 F5 F6 F7 F8 F9",
    f"""SELECT doy, tmmx_f, tmmn_f, rmin, n, round(vpd, 4) AS vpd, round(dl, 6) AS daylength,
  round(gsi, 6) AS gsi, round(herb_doy, 6) AS herb_doy, round(woody_doy, 6) AS woody_doy,
  round(30 + {clip_sql('(gsi - 0.5) / 0.5', 0, 1)} * 220, 6) AS herb_gsi,
  round(60 + {clip_sql('(gsi - 0.5) / 0.5', 0, 1)} * 140, 6) AS woody_gsi
FROM (SELECT *, {GSI} AS gsi FROM (
 SELECT *, greatest(0, es - es * rmin / 100) AS vpd,
   2 * degrees(acos({clip_sql(f'-tan(radians(40)) * tan({DECL})', -1, 1)})) / 15 AS dl,
   250 + {clip_sql('(doy - 91) / 159', 0, 1)} * -220 AS herb_doy,
   {clip_sql('130 + 70 * cos(pi() * (doy - 152) / 122)', 50, 200)} AS woody_doy
 FROM (SELECT doy, round(tmmx_f, 2) AS tmmx_f, round(tmmn_f, 2) AS tmmn_f, rmin, count(*) AS n,
   610.78 * exp(17.2694 * ((round(tmmx_f, 2) - 32) * 5 / 9) / ((round(tmmx_f, 2) - 32) * 5 / 9 + 237.3)) AS es
   FROM {{wx}} GROUP BY ALL)))""",
)
def live_fuel_moisture(t):
    base = t.wx.groupBy(
        "doy", F.round("tmmx_f", 2).alias("tmmx_f"), F.round("tmmn_f", 2).alias("tmmn_f"), "rmin"
    ).agg(F.count("*").alias("n"))
    out = base.withColumns(
        {
            "vpd": nfdrs.calc_vpd_pa("tmmx_f", "rmin"),
            "daylength": nfdrs.calc_daylength("doy", 40.0),
            "herb_doy": nfdrs.calc_herb_fm("doy"),
            "woody_doy": nfdrs.calc_woody_fm("doy"),
        }
    ).withColumn("gsi", nfdrs.calc_gsi("tmmn_f", "vpd", "daylength"))
    out = out.withColumns(
        {
            "herb_gsi": nfdrs.calc_herb_fm_gsi("gsi"),
            "woody_gsi": nfdrs.calc_woody_fm_gsi("gsi"),
        }
    )
    return r6(out, "daylength", "gsi", "herb_doy", "woody_doy", "herb_gsi", "woody_gsi").withColumn(
        "vpd", F.round("vpd", 4)
    )


@query(
    "F10",
    """SELECT event_id, round(sqrt(u * u + v * v) * 2.23694, 6) AS ws_mph,
  round((degrees(atan2(-u, -v)) + 360) % 360, 6) AS wd_deg FROM {obs_uv}""",
)
def wind_from_components(t):
    return r6(
        t.obs_uv.select(
            "event_id", wind.wind_speed_mph("u", "v").alias("ws_mph"),
            wind.wind_direction_deg("u", "v").alias("wd_deg"),
        )
    )


def steps_sql(x: str, edges, labels, last, op: str = "<") -> str:
    whens = " ".join(f"WHEN {x} {op} {e} THEN {v}" for e, v in zip(edges, labels, strict=True))
    return f"CASE {whens} ELSE {last} END"


DOWN, UP = (10, 9, 8, 7, 6, 5, 4, 3, 2), (1, 2, 3, 4, 5, 6, 7, 8, 9)
SLOPE_CLS = steps_sql("sp", range(6, 47, 5), DOWN, 1)
ASPECT_CLS = """CASE WHEN asp >= 337.5 OR asp < 22.5 THEN 10 WHEN asp < 67.5 THEN 8
  WHEN asp < 112.5 THEN 6 WHEN asp < 157.5 THEN 4 WHEN asp < 202.5 THEN 1 WHEN asp < 247.5 THEN 3
  WHEN asp < 292.5 THEN 5 ELSE 7 END"""
FL_CLS = steps_sql("flamelength", (0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5), UP, 10, "<=")
HUA_CLS = steps_sql(
    "heatarea * 0.2388459", (380, 1265, 1415, 1610, 1905, 2190, 4500, 6630, 8000), UP, 10, "<="
)


@query(
    "F11 F12 F15 F16 F17 F18 F19 F20 F22",
    f"""SELECT pix, round(sp, 6) AS slope_pct, {ASPECT_CLS} AS aspect_class,
  {SLOPE_CLS} AS slope_class,
  CASE WHEN flamelength IS NULL THEN NULL ELSE {FL_CLS} END AS fl_class, {HUA_CLS} AS hua_class,
  {steps_sql('sp', (20, 30, 40), (1.0, 0.75, 0.625), 0.5)}::DOUBLE AS hand,
  {steps_sql('sp', (30, 40), (1.0, 0.5), 0.0)}::DOUBLE AS mach,
  {steps_sql('sp', (16, 31, 46), (1.0, 0.8, 0.6), 0.5)}::DOUBLE AS hand_smooth,
  {steps_sql('sp', (16, 21, 26, 31, 36), (1.0, 0.8, 0.7, 0.6, 0.5), 0.0)}::DOUBLE AS mach_smooth,
  {steps_sql('sp', (10, 20, 30, 40, 50), (0.01, 0.1, 0.2, 0.4, 0.6), 0.8, '<=')}::DOUBLE AS hazard,
  CASE WHEN flamelength IS NULL THEN NULL ELSE
    round(2.0 * ({FL_CLS}) * ({HUA_CLS}) / (({FL_CLS}) + ({HUA_CLS})), 6) END AS energy
FROM (SELECT *, tan(radians(slpd)) * 100 AS sp FROM {{px}})""",
)
def suppression_classes(t):
    sp = sc.slope_pct_from_deg("slpd")
    px = t.px.withColumn("slope_pct", sp)
    fl, hua = sc.classify_fl("flamelength"), sc.classify_hua("heatarea")
    return r6(
        px.select(
            "pix", "slope_pct", sc.classify_aspect("asp").alias("aspect_class"),
            sc.classify_slope_pen("slope_pct").alias("slope_class"), fl.alias("fl_class"),
            hua.alias("hua_class"), sc.slope_adjust_hand("slope_pct").alias("hand"),
            sc.slope_adjust_mach("slope_pct").alias("mach"),
            sc.slope_adjust_hand("slope_pct", "smoothed").alias("hand_smooth"),
            sc.slope_adjust_mach("slope_pct", "smoothed").alias("mach_smooth"),
            sc.slope_hazard("slope_pct").alias("hazard"),
            F.round(sc.energy(fl, hua), 6).alias("energy"),
        ),
        "slope_pct",
    )


@query(
    "F13 F14 F21 F23 F24",
    f"""SELECT pix, {steps_sql('tl', range(10, 91, 10), UP, 10)} AS trail_class,
  {steps_sql('dist', range(100, 901, 100), DOWN, 1, '<=')} AS access_class,
  round((cc % 10 + ch % 11 + cbh % 11 + 2 * ({steps_sql('tl', range(10, 91, 10), UP, 10)})) / 5.0, 6) AS penetr,
  round((ch % 11) * (0.75::DOUBLE + 0.5), 6) AS fireline,
  round(sdi / ((ch % 11) + 1.0::DOUBLE + cbh), 6) AS sdi_value
FROM (SELECT *, CAST(pix % 130 AS DOUBLE) AS tl, CAST(pix % 1100 AS DOUBLE) AS dist FROM {{px}})""",
)
def suppression_formulas(t):
    px = t.px.withColumns(
        {
            "tl": (F.col("pix") % 130).cast("double"),
            "dist": (F.col("pix") % 1100).cast("double"),
        }
    )
    c = F.col
    trail = sc.classify_trail_length("tl")
    return r6(
        px.select(
            "pix", trail.alias("trail_class"), sc.classify_accessibility("dist").alias("access_class"),
            sc.penetrability(c("cc") % 10, c("ch") % 11, c("cbh") % 11, trail).alias("penetr"),
            sc.fireline(c("ch") % 11, F.lit(0.75), F.lit(0.5)).alias("fireline"),
            sc.sdi_value(c("sdi").cast("double"), c("ch") % 11, c("cbh"), F.lit(0)).alias("sdi_value"),
        )
    )


@query(
    "F25 F28 F26 F34 F31",
    """SELECT c_custkey, lower(replace(replace(seg, ' ', '_'), '/', '-')) AS safe,
  lower(replace(replace(seg, '-', ''), '_', '')) AS normal,
  CASE WHEN position('_' IN seg) > 0 THEN split_part(seg, '_', 2) ELSE seg END AS band,
  concat('p', CAST(c_nationkey % 100 AS INT)) AS pkey,
  CASE c_nationkey % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5
    WHEN 5 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 8 WHEN 8 THEN 9 END AS code
FROM (SELECT *, concat(c_mktsegment, CASE c_nationkey % 4 WHEN 0 THEN ' x/y' WHEN 1 THEN '_B-c'
  WHEN 2 THEN '' ELSE '_D_e' END) AS seg FROM {customer})""",
)
def name_functions(t):
    kinds = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential",
             "service", "track", "steps", "proposed"]
    k = F.col("c_nationkey") % 4
    tail = F.when(k == 0, " x/y").when(k == 1, "_B-c").when(k == 2, "").otherwise("_D_e")
    df = t.customer.withColumn("seg", F.concat("c_mktsegment", tail))
    kind = F.get(F.array(*[F.lit(x) for x in kinds]), F.col("c_nationkey") % 11)
    return df.select(
        "c_custkey", names.safe_name("seg").alias("safe"), names.normalize("seg").alias("normal"),
        names.normalize_band_name("seg").alias("band"),
        names.percentile_key((F.col("c_nationkey") % 100) / 100).alias("pkey"),
        names.highway_code(kind).alias("code"),
    )


@query(
    "F27 F32 F33 F36",
    """SELECT p_partkey,
  CASE p_partkey % 4 WHEN 0 THEN 'CC' WHEN 1 THEN 'FBFM40' WHEN 2 THEN 'SLP' ELSE 'ELEV' END AS label,
  concat('/out/lcp', p_size, '/s', p_partkey, '/s', p_partkey, '_LCP', p_size, '.tif') AS stacked,
  concat('mechthin', p_size, 'deltasdi', p_partkey % 100) AS field,
  CASE p_partkey % 3 WHEN 0 THEN 'Composite' WHEN 1 THEN 'Composite' ELSE 'Water' END AS baseline_name,
  CASE p_partkey % 3 WHEN 0 THEN 'tot' WHEN 2 THEN 'wat' END AS hvra_code
FROM {part}""",
)
def label_functions(t):
    c = F.col
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), c("p_partkey") % n)
    s = lambda x: F.col(x).cast("string")
    lcp = F.concat(F.lit("/data/x.y/lcp"), s("p_size"), F.lit(".tif"))
    raster = F.concat(
        F.lit("/r/mech_thin_"), s("p_size"), F.lit("_delta_sdi_Pct"),
        (c("p_partkey") % 100).cast("string"), F.lit("_area.tif"),
    )
    hvra = pick(3, "Total", "Composite", "Water")
    return t.part.select(
        "p_partkey",
        names.band_label(pick(4, "US_200CC_19", "US_220F40_20", "SLPD2020", "AK_ELEV2020")).alias("label"),
        names.stacked_output_path(F.lit("/out"), lcp, F.concat(F.lit("s"), s("p_partkey"))).alias("stacked"),
        names.treatment_field(raster).alias("field"), names.hvra_baseline(hvra).alias("baseline_name"),
        names.hvra_code(hvra, {"Total": "tot", "Water": "wat"}).alias("hvra_code"),
    )


@query(
    "F29",
    """SELECT p_partkey, CASE WHEN NOT (coalesce(lower(trim(ty)), '') = 'thinning' OR act LIKE '%thin%'
    OR act LIKE '%salvage%' OR act LIKE '%improvement cut%') THEN NULL
  WHEN eq IN ('chain saw', 'hand saw') THEN 'Manual'
  WHEN eq IN ('dozer', 'masticator') THEN 'Mechanical'
  WHEN mth IN ('manual', 'power hand') THEN 'Manual' ELSE 'Mechanical' END AS thin
FROM (SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN ' Thinning ' WHEN 1 THEN 'Burning' ELSE NULL END AS ty,
  lower(CASE p_partkey % 7 WHEN 0 THEN 'Precommercial Thin' WHEN 1 THEN 'Salvage Cut'
    WHEN 2 THEN 'Improvement Cut x' WHEN 3 THEN 'Mowing' ELSE '' END) AS act,
  lower(CASE p_size % 6 WHEN 0 THEN 'Chain Saw' WHEN 1 THEN 'dozer' WHEN 2 THEN 'hand saw'
    WHEN 3 THEN 'Masticator' ELSE '' END) AS eq,
  lower(CASE p_size % 4 WHEN 0 THEN 'Manual' WHEN 1 THEN 'power hand' WHEN 2 THEN 'Helicopter'
    ELSE '' END) AS mth FROM {part})""",
)
def thinning_class(t):
    pick = lambda c, n, *v: F.get(
        F.array(*[F.lit(x).cast("string") for x in v]), (F.col(c) % n).cast("int")
    )
    return t.part.select(
        "p_partkey",
        thin.classify_thin(
            pick("p_partkey", 5, " Thinning ", "Burning", None, None, None),
            pick("p_partkey", 7, "Precommercial Thin", "Salvage Cut", "Improvement Cut x", "Mowing",
                 None, None, None),
            pick("p_size", 6, "Chain Saw", "dozer", "hand saw", "Masticator", None, None),
            pick("p_size", 4, "Manual", "power hand", "Helicopter", None),
        ).alias("thin"),
    )


@query(
    "F30",
    """SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'track' ELSE '' END AS first_tag,
  CASE c_nationkey % 3 WHEN 0 THEN concat(c_mktsegment, ', path') WHEN 1 THEN 'track' ELSE 'unknown' END AS all_tags
FROM {customer}""",
)
def tag_functions(t):
    k = F.col("c_nationkey") % 3
    tags = F.when(k == 0, F.array("c_mktsegment", F.lit("path"))).when(k == 1, F.array(F.lit("track")))
    df = t.customer.withColumn("tags", tags)
    return df.select(
        "c_custkey", names.flatten_tag("tags").alias("first_tag"), names.tag_text("tags").alias("all_tags")
    )


Q = """((1 - e2) * (sin(radians({lat})) / (1 - e2 * sin(radians({lat})) ** 2)
  - ln((1 - sqrt(e2) * sin(radians({lat}))) / (1 + sqrt(e2) * sin(radians({lat})))) / (2 * sqrt(e2))))"""
M2 = "(cos(radians({lat})) ** 2 / (1 - e2 * sin(radians({lat})) ** 2))"


@query(
    "G29",
    f"""SELECT fire_id, round(rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y FROM (
 SELECT *, 6378137.0 * sqrt(c - n * {Q.format(lat='lat')}) / n AS rho,
   6378137.0 * sqrt(c - n * {Q.format(lat='23')}) / n AS rho0, n * radians(lon + 96) AS theta FROM (
  SELECT *, {M2.format(lat='29.5')} + n * {Q.format(lat='29.5')} AS c FROM (
   SELECT fire_id, lon, lat, e2,
    ({M2.format(lat='29.5')} - {M2.format(lat='45.5')}) / ({Q.format(lat='45.5')} - {Q.format(lat='29.5')}) AS n
   FROM (SELECT *, (1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE) AS e2 FROM {{fires}}))))"""
)
def project_to_albers(t):
    x, y = albers.to_epsg5070("lon", "lat")
    return t.fires.select("fire_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "P10 P11 P12",
    """SELECT pix,
  CASE WHEN flamelength > 0 THEN CASE WHEN flamelength < 0.6096 THEN 0 WHEN flamelength < 1.2192 THEN 1
    WHEN flamelength < 2.4384 THEN 2 WHEN flamelength < 3.6576 THEN 3 ELSE 4 END END AS fl_class,
  CASE WHEN bp < 0.25 THEN 0 WHEN bp < 0.5 THEN 1 WHEN bp < 0.75 THEN 2 WHEN bp >= 0.75 THEN 3 END AS bp_bin,
  CASE WHEN crownstate BETWEEN 0 AND 3 THEN CAST(crownstate AS INT) END AS cs,
  CASE CASE WHEN crownstate BETWEEN 0 AND 3 THEN CAST(crownstate AS INT) END WHEN 0 THEN 'NonBurnable'
    WHEN 1 THEN 'Surface' WHEN 2 THEN 'Passive Crown' WHEN 3 THEN 'Active Crown' END AS cs_label
FROM {px}""",
)
def raster_classes(t):
    return t.px.select(
        "pix", bins.bin_fl("flamelength").cast("int").alias("fl_class"),
        bins.bin_raster("bp", (0.25, 0.5, 0.75)).alias("bp_bin"),
        bins.clean_crown_state("crownstate").cast("int").alias("cs"),
        bins.class_label(bins.clean_crown_state("crownstate"), bins.CS_LABELS).alias("cs_label"),
    )

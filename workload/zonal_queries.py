"""Zonal statistics and baseline-versus-treated comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.functions import bins
from firegrid.operators import change, geometry, nvc, rasterize, spread, zonal
from firegrid.operators.spatial_join import near_line_flag

from .registry import query, r6
from .spatial_queries import POD_FLAG
from .views import FEAS, HVRAS, border_sql, cells_sql

FL = """CASE WHEN flamelength > 0 THEN CASE WHEN flamelength < 0.6096 THEN 0 WHEN flamelength < 1.2192 THEN 1
  WHEN flamelength < 2.4384 THEN 2 WHEN flamelength < 3.6576 THEN 3 ELSE 4 END END"""
FL_FT = """CASE WHEN flamelength < 2 THEN 0 WHEN flamelength < 4 THEN 1 WHEN flamelength < 8 THEN 2
  WHEN flamelength < 12 THEN 3 WHEN flamelength >= 12 THEN 4 END"""
CS = "CASE WHEN crownstate BETWEEN 0 AND 3 THEN CAST(crownstate AS INT) END"


def label_sql(x: str, labels) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(labels)) + " END"


def shares(cells: str, raster: str, cls: str, keys: str, join: str) -> str:
    return f"""SELECT {keys}, c, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY {keys}) * 100.0::DOUBLE AS pct
FROM (SELECT *, {cls} AS c FROM {raster} JOIN {cells} USING ({join})) WHERE c IS NOT NULL GROUP BY {keys}, c"""


@query(
    "A1",
    f"""SELECT feature_id, c AS class_val, n AS pixel_count, round(pct, 6) AS pct_cover FROM
({shares('{zone_grid}', '{px}', FL, 'feature_id', 'row, col')})""",
)
def flame_classes_by_zone(t):
    zones = rasterize.disjoint_spans(rasterize.polygon_spans(t.zone_edges, t.grid), t.zone_attr)
    zoned = rasterize.join_pixels(t.px.select("row", "col", "flamelength"), zones)
    out = zonal.zonal_categorical(zoned, bins.bin_fl("flamelength").cast("int"))
    return r6(out)


@query(
    "A1",
    f"""SELECT feature_id, c AS class_val, n AS pixel_count, round(n / t * 100.0::DOUBLE, 6) AS pct_cover FROM
 (SELECT feature_id, {FL} AS c, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature_id) AS t
  FROM {{px}} JOIN {{zone_grid}} USING (row, col) GROUP BY feature_id, c) WHERE c IS NOT NULL""",
)
def flame_classes_with_nodata(t):
    zones = rasterize.disjoint_spans(rasterize.polygon_spans(t.zone_edges, t.grid), t.zone_attr)
    zoned = rasterize.join_pixels(t.px.select("row", "col", "flamelength"), zones)
    return r6(
        zonal.zonal_categorical(
            zoned, bins.bin_fl("flamelength").cast("int"), nodata_in_denominator=True
        )
    )


@query(
    "A2",
    """SELECT feature_id, round(avg(sdi / 100.0::DOUBLE), 6) AS mean, round(sum(sdi / 100.0::DOUBLE), 6) AS sum,
  count(*) AS count, round(stddev_pop(sdi / 100.0::DOUBLE), 6) AS std
FROM {px} JOIN {zone_grid} USING (row, col) WHERE sdi <> 700 GROUP BY feature_id""",
)
def sdi_stats_by_zone(t):
    zones = rasterize.disjoint_spans(rasterize.polygon_spans(t.zone_edges, t.grid), t.zone_attr)
    zoned = rasterize.join_pixels(t.px.select("row", "col", "sdi"), zones)
    return r6(
        zonal.zonal_continuous(
            zoned, "sdi", ["mean", "sum", "count", "std"], nodata=700, scale_factor=100.0
        )
    )


@query(
    "A3",
    f"""SELECT feature_id, c AS cs, n AS cs_count, round(pct, 6) AS cs_pct_cover FROM
({shares('{zone_touched}', '{px}', CS, 'feature_id', 'row, col')})""",
)
def crown_states_touched(t):
    zoned = rasterize.join_pixels(
        t.px.select("row", "col", "crownstate"), rasterize.touched_spans(t.zone_edges, t.grid)
    )
    return r6(zonal.band_stats(zoned, bins.clean_crown_state("crownstate").cast("int"), "cs"))


@query(
    "A3",
    """SELECT feature_id, round(sum(bp), 6) AS bp_sum, round(avg(bp), 6) AS bp_mean, count(bp) AS bp_count,
  min(bp) AS bp_min, max(bp) AS bp_max FROM {px} JOIN {zone_touched} USING (row, col) WHERE bp IS NOT NULL GROUP BY feature_id""",
)
def burn_probability_touched(t):
    zoned = rasterize.join_pixels(
        t.px.select("row", "col", "bp"), rasterize.touched_spans(t.zone_edges, t.grid)
    )
    return r6(
        zonal.band_stats(zoned, "bp", "bp", ["sum", "mean", "count", "min", "max"], "continuous")
    )


def change_sql(cls: str, labels, p: str) -> str:
    return f"""SELECT feature_id, type, acres_gis, percentile, lower(replace(replace(type, ' ', '_'), '/', '-')) AS scenario,
 {label_sql('c', labels)} AS {p}_class, coalesce(bl.n, 0) AS {p}_bl_count, coalesce(bl.pct, 0) AS {p}_bl_pct,
 coalesce(tr.n, 0) AS {p}_tr_count, coalesce(tr.pct, 0) AS {p}_tr_pct, coalesce(tr.pct, 0) - coalesce(bl.pct, 0) AS delta_pct
FROM ({shares('{zone_grid}', '{fire_bl}', cls, 'feature_id, percentile', 'row, col')}) bl
FULL JOIN ({shares('{zone_grid_type}', '{fire_tr}', cls, 'feature_id, percentile', 'type, row, col')}) tr USING (feature_id, percentile, c)
JOIN {{zone_attr}} USING (feature_id)"""


FL_LABELS = ("0-2ft", "2-4ft", "4-8ft", "8-12ft", ">12ft")
CS_LABELS = ("NonBurnable", "Surface", "Passive Crown", "Active Crown")
FL_CHANGE = change_sql(FL, FL_LABELS, "fl")
CS_CHANGE = change_sql(CS, CS_LABELS, "cs")


def rounded_change(p: str, source: str) -> str:
    return f"""SELECT feature_id, type, acres_gis, percentile, scenario, {p}_class, {p}_bl_count, round({p}_bl_pct, 6) AS {p}_bl_pct,
 {p}_tr_count, round({p}_tr_pct, 6) AS {p}_tr_pct, round(delta_pct, 6) AS delta_pct FROM {{{source}}}"""


def fl_changes(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    return change.flame_length_change(t.fire_bl, t.fire_tr, spans, t.zone_attr)


@query("A4 J2 J6 J7", rounded_change("fl", "fl_change"), fl_change=FL_CHANGE)
def flame_length_change(t):
    return r6(fl_changes(t))


@query("A5", rounded_change("cs", "cs_change"), cs_change=CS_CHANGE)
def crown_state_change(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    return r6(change.crown_state_change(t.fire_bl, t.fire_tr, spans, t.zone_attr))


@query(
    "A6 J4",
    """SELECT feature_id, type, acres_gis, lower(replace(replace(type, ' ', '_'), '/', '-')) AS scenario,
  round(bl, 6) AS sdi_bl_mean, round(tr, 6) AS sdi_tr_mean, round(bl - tr, 6) AS sdi_delta_mean
FROM {zone_attr} JOIN (SELECT feature_id, avg(sdi) / 100 AS bl FROM {px} JOIN {zone_grid} USING (row, col) GROUP BY 1) USING (feature_id)
LEFT JOIN (SELECT feature_id, avg(sdi) / 100 AS tr FROM {sdi_tr} JOIN {zone_grid_type} USING (type, row, col) GROUP BY 1) USING (feature_id)""",
)
def sdi_change(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    return r6(change.sdi_change(t.px.select("row", "col", "sdi"), t.sdi_tr, spans, t.zone_attr))


@query(
    "A7 G4",
    """SELECT a.feature_id, a.type, round_even(count(p.bp) * 900 / 4046.86::DOUBLE, 2) AS acres_gis,
  round(avg(p.bp), 6) AS bp_bl_mean, round(avg(r.bp), 6) AS bp_tr_mean,
  round(avg(p.bp - r.bp), 6) AS bp_delta_mean, max(p.bp) AS bp_bl_max, max(r.bp) AS bp_tr_max
FROM {zone_attr} a LEFT JOIN {zone_touched} z USING (feature_id) LEFT JOIN {px} p ON p.row = z.row AND p.col = z.col
LEFT JOIN {bp_tr} r ON r.type = a.type AND r.row = z.row AND r.col = z.col GROUP BY ALL""",
)
def burn_probability_change(t):
    out = spread.burn_probability_change(
        t.px.select("row", "col", "bp"), t.bp_tr, t.zone_edges, t.zone_attr, t.grid, digits=13
    )
    return r6(out)


WEDGES = """
SELECT feature_id, cx + CASE WHEN i = 0 THEN 0 ELSE 300 * cos(radians(90 - (az - 22.5 + (i - 1) * 45.0::DOUBLE / 31))) END AS x1,
  cy + CASE WHEN i = 0 THEN 0 ELSE 300 * sin(radians(90 - (az - 22.5 + (i - 1) * 45.0::DOUBLE / 31))) END AS y1,
  cx + CASE WHEN i = 32 THEN 0 ELSE 300 * cos(radians(90 - (az - 22.5 + i * 45.0::DOUBLE / 31))) END AS x2,
  cy + CASE WHEN i = 32 THEN 0 ELSE 300 * sin(radians(90 - (az - 22.5 + i * 45.0::DOUBLE / 31))) END AS y2
FROM {centers}, range(33) r(i)"""
CENTERS = """
SELECT feature_id, (feature_id * 37) % 360 AS wd, ((feature_id * 37) % 360 + 180) % 360 AS az,
  sum(s * mx) / (6 * sum(s * a)) AS cx, sum(s * my) / (6 * sum(s * a)) AS cy FROM (
 SELECT *, CASE ring WHEN 0 THEN 1 ELSE -1 END * sign(a) AS s FROM (
  SELECT feature_id, part, ring, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx,
   sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM {zone_edges} GROUP BY ALL)) GROUP BY feature_id"""


@query(
    "A8 G26",
    """SELECT feature_id, wd::DOUBLE AS wind_direction, round(avg(d), 6) AS mean_delta_bp, round(max(d), 6) AS max_delta_bp,
  count(*) FILTER (WHERE d > 0) * 0.09::DOUBLE AS area_improved_ha,
  coalesce(round(count(*) FILTER (WHERE d > 0) / nullif(count(d), 0)::DOUBLE * 100, 6), 0) AS pct_area_improved
FROM {centers} LEFT JOIN (SELECT feature_id, bp - bp_tr AS d FROM {px} JOIN (
  SELECT * FROM {wedge_in} UNION SELECT * FROM {wedge_on}) USING (row, col) WHERE bp - bp_tr IS NOT NULL) USING (feature_id)
GROUP BY ALL""".replace("* 0.09::DOUBLE AS area_improved_ha", "* 0.09::DOUBLE AS area_improved_ha"),
    centers=CENTERS, wedges=WEDGES, wedge_in=cells_sql("wedges"), wedge_on=border_sql("wedges"),
)
def downwind_effect(t):
    wd = (F.col("feature_id") * 37) % 360
    centers = geometry.centroids(t.zone_edges).withColumn("wind_direction", wd)
    delta = t.px.select("row", "col", (F.col("bp") - F.col("bp_tr")).alias("delta_bp"))
    return r6(
        spread.downwind_effect(centers, delta, t.grid, buffer_km=0.3),
        "mean_delta_bp", "max_delta_bp", "pct_area_improved",
    )


@query(
    "A9 J10 F36",
    """SELECT feature_id, hvra, type, round(bs, 6) AS nvc_bl_sum, round(bm, 6) AS nvc_bl_mean, bn AS nvc_bl_npix,
  round(ts, 6) AS nvc_tr_sum, round(tm, 6) AS nvc_tr_mean, round(ts - bs, 6) AS nvc_dlt_sum, round(tm - bm, 6) AS nvc_dlt_mean,
  round(CASE WHEN bs <> 0 THEN (ts - bs) / abs(bs) * 100 END, 6) AS nvc_pct_chg
FROM (SELECT feature_id, CASE hvra WHEN 'Composite' THEN 'Total' ELSE hvra END AS hvra, sum(nvc) AS bs, avg(nvc) AS bm, count(nvc) AS bn
  FROM {nvc_bl} JOIN {zone_touched} USING (row, col) WHERE nvc IS NOT NULL GROUP BY ALL)
LEFT JOIN (SELECT feature_id, hvra, type, sum(nvc) AS ts, avg(nvc) AS tm FROM {nvc_tr} JOIN {zone_touched} USING (row, col)
  JOIN {zone_attr} USING (feature_id, type) WHERE nvc IS NOT NULL GROUP BY ALL) USING (feature_id, hvra)""",
)
def project_value_change(t):
    touched = rasterize.touched_spans(t.zone_edges, t.grid)
    return r6(nvc.project_nvc(t.nvc_bl, t.nvc_tr, touched, t.zone_attr, HVRAS))


@query(
    "A10 P21 P22",
    """SELECT unit_name, unit_id, hvra, scenario, sum(nvc) AS nvc_total, sum(nvc) FILTER (WHERE comp) AS nvc_feas,
  sum(nvc) FILTER (WHERE ok AND feas = 1) AS nvc_feas_scen, round(count(*) * 900 / 4046.86::DOUBLE, 6) AS acres_total,
  round(count(*) FILTER (WHERE comp) * 900 / 4046.86::DOUBLE, 6) AS acres_feas,
  round(count(*) FILTER (WHERE ok AND feas = 1) * 900 / 4046.86::DOUBLE, 6) AS acres_feas_scenario
FROM (SELECT row, col, scenario, feas, coalesce(undisturbed = 1 AND burnable = 1 AND bps = 1, false) AS ok,
   coalesce(undisturbed = 1 AND burnable = 1 AND bps = 1, false)
   AND count(*) FILTER (WHERE feas >= 1) OVER (PARTITION BY row, col) >= 3 AS comp FROM {feas} JOIN {masks} USING (row, col))
JOIN {nvc_bl} USING (row, col) JOIN (
 SELECT 'zone' AS unit_name, feature_id AS unit_id, row, col FROM {zone_touched}
 UNION ALL SELECT 'region', region_id, row, col FROM {region_cells}) USING (row, col) WHERE nvc IS NOT NULL GROUP BY ALL""",
)
def landscape_value(t):
    zones = rasterize.touched_spans(t.zone_edges, t.grid).select(
        F.lit("zone").alias("unit_name"), F.col("feature_id").alias("unit_id"), "row", "c0", "c1"
    )
    regions = rasterize.polygon_spans(t.region_edges, t.grid, ["region_id"]).select(
        F.lit("region").alias("unit_name"), F.col("region_id").cast("bigint").alias("unit_id"), "row", "c0", "c1"
    )
    pixels = t.nvc_bl.join(t.masks, ["row", "col"])
    out = nvc.landscape_nvc(
        pixels, t.feas, zones.unionByName(regions), FEAS, t.grid,
        masks=("undisturbed", "burnable", "bps"),
    )
    return r6(out, "acres_total", "acres_feas", "acres_feas_scenario")


def touched_change(cls: str, labels, p: str, fill: bool) -> str:
    z = (lambda x: f"coalesce({x}, 0)") if fill else (lambda x: x)
    bl = shares("{zone_touched}", "{fire_bl}", cls, "feature_id, percentile", "row, col")
    tr = f"""SELECT feature_id, percentile, type, c, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY feature_id, percentile) * 100.0::DOUBLE AS pct
 FROM (SELECT *, {cls} AS c FROM {{fire_tr}} JOIN {{zone_touched}} USING (row, col) JOIN {{zone_attr}} USING (feature_id, type))
 WHERE c IS NOT NULL GROUP BY feature_id, percentile, type, c"""
    typ = "coalesce(tr.type, a.type)" if fill else "tr.type"
    metric = "Crownstate" if fill else "Flamelength"
    return f"""SELECT feature_id, {typ} AS type, percentile, {label_sql('c', labels)} AS {p}_class, bl.n AS {p}_bl_count,
 round({z('bl.pct')}, 6) AS {p}_bl_pct, tr.n AS {p}_tr_count, round({z('tr.pct')}, 6) AS {p}_tr_pct,
 round({z('tr.pct')} - {z('bl.pct')}, 6) AS delta_pct, '{metric}' AS metric
FROM ({bl}) bl FULL JOIN ({tr}) tr USING (feature_id, percentile, c) JOIN {{zone_attr}} a USING (feature_id)"""


@query("A11 J3 P11", touched_change(FL_FT, FL_LABELS, "fl", False))
def flame_length_change_ft(t):
    touched = rasterize.touched_spans(t.zone_edges, t.grid)
    return r6(change.flame_length_change_ft(t.fire_bl, t.fire_tr, touched, t.zone_attr))


@query("A12", touched_change("CAST(crownstate AS INT)", ("NB", "Surface", "Passive", "Active"), "cs", True))
def crown_state_change_touched(t):
    touched = rasterize.touched_spans(t.zone_edges, t.grid)
    return r6(change.crown_state_change_touched(t.fire_bl, t.fire_tr, touched, t.zone_attr))


@query(
    "A13 G9 J5",
    """SELECT feature_id, type AS scenario, pod_line, round(bl, 6) AS sdi_bl, round(tr, 6) AS sdi_tr, round(tr - bl, 6) AS delta_sdi,
  round(CASE WHEN bl >= 1 THEN (tr - bl) / bl * 100 END, 6) AS delta_sdi_pct
FROM (SELECT feature_id, avg(sdi) AS bl FROM {px} JOIN {zone_touched} USING (row, col) GROUP BY 1)
JOIN (SELECT feature_id, type, avg(sdi) AS tr FROM {sdi_tr} JOIN {zone_touched} USING (row, col)
  JOIN {zone_attr} USING (feature_id, type) GROUP BY 1, 2) USING (feature_id)
LEFT JOIN {pod_flag} USING (feature_id)""",
    pod_flag=POD_FLAG,
)
def sdi_by_pod_position(t):
    touched = rasterize.touched_spans(t.zone_edges, t.grid)
    flags = near_line_flag(t.zone_edges, t.pod_lines, 120.0)
    return r6(
        nvc.sdi_by_pod_position(t.px.select("row", "col", "sdi"), t.sdi_tr, touched, t.zone_attr, flags)
    )


@query(
    "A14",
    """SELECT feature_id, count(*) FILTER (WHERE cs > 0 AND cs_tr > 0) AS n_valid,
  count(*) FILTER (WHERE cs > 0 AND cs_tr > 0 AND cs_tr < cs) AS n_reduced,
  round(count(*) FILTER (WHERE cs > 0 AND cs_tr > 0 AND cs_tr < cs) / nullif(count(*) FILTER (WHERE cs > 0 AND cs_tr > 0), 0)::DOUBLE, 6) AS prop_reduced
FROM (SELECT row, col, crownstate AS cs, CAST(pix % 3 AS DOUBLE) AS cs_tr FROM {px}) JOIN {zone_cells} USING (row, col) GROUP BY feature_id""",
)
def crown_reduction(t):
    pixels = t.px.select(
        "row", "col", F.col("crownstate").alias("cs_bl"), (F.col("pix") % 3).cast("double").alias("cs_tr")
    )
    zoned = rasterize.join_pixels(pixels, rasterize.polygon_spans(t.zone_edges, t.grid))
    return r6(change.crown_reduction(zoned))

"""Spatial operators; the checking SQL compares every pixel (or pair) by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import distance, geometry, lines, overlap, rasterize, spatial_join, zonal
from firegrid.plans import suppression
from firegrid.sources import tables as src

from .pixel_queries import _near
from .registry import query, r6
from .scalar_queries import ASPECT_CLS, DOWN, FL_CLS, HUA_CLS, SLOPE_CLS, UP, steps_sql
from .views import CELL

LINE_COLS = ("feature_id", "x1", "y1", "x2", "y2")


def cells_of_pixels(t, spans):
    """Covered cells that exist in the landscape."""
    return rasterize.join_pixels(t.px.select("row", "col"), spans)


@query("G3", "SELECT row, col, feature_id FROM {zone_grid}")
def rasterized_zones(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    return rasterize.zone_pixels(spans, t.zone_attr)


@query("G4", "SELECT feature_id, row, col FROM {zone_touched}")
def touched_zones(t):
    return rasterize.span_cells(rasterize.touched_spans(t.zone_edges, t.grid))


@query("G5", "SELECT DISTINCT feature_id, row, col FROM {road_cells}")
def rasterized_lines(t):
    return rasterize.span_cells(rasterize.line_spans(t.roads, t.grid))


@query(
    "G6",
    """SELECT fire_id, CAST(floor(-y / 30) AS INT) AS row, CAST(floor(x / 30) AS INT) AS col FROM {fires}
WHERE floor(x / 30) BETWEEN 0 AND 99 AND floor(-y / 30) BETWEEN 0 AND (SELECT max(row) FROM {px})""",
)
def rasterized_points(t):
    return rasterize.point_cells(t.fires, t.grid).select("fire_id", "row", "col")


@query(
    "P15 J6",
    "SELECT p.row, p.col, p.flamelength FROM {px} p WHERE EXISTS (SELECT 1 FROM {zone_cells} z WHERE z.row = p.row AND z.col = p.col)",
)
def clipped_to_zones(t):
    spans = rasterize.polygon_spans(t.zone_edges, t.grid)
    return rasterize.clip_pixels(t.px.select("row", "col", "flamelength"), spans)


ROAD_DIST = """
SELECT p.row, p.col, min(sqrt((p.row - r.row) * (p.row - r.row) + (p.col - r.col) * (p.col - r.col))) * 30 AS distance_m
FROM {px} p JOIN (SELECT DISTINCT row, col FROM {road_cells} WHERE highway_code <= 7) r
  ON p.row BETWEEN r.row - 30 AND r.row + 30 AND p.col BETWEEN r.col - 30 AND r.col + 30
GROUP BY p.row, p.col
HAVING min((p.row - r.row) * (p.row - r.row) + (p.col - r.col) * (p.col - r.col)) <= 900"""
TRAIL_DENS = """
SELECT p.row, p.col, count(*) * 30::DOUBLE AS trail_m
FROM {px} p JOIN (SELECT DISTINCT row, col FROM {trail_cells}) r
  ON p.row BETWEEN r.row - 2 AND r.row + 2 AND p.col BETWEEN r.col - 2 AND r.col + 2
 AND (p.row - r.row) * (p.row - r.row) + (p.col - r.col) * (p.col - r.col) <= 4
GROUP BY p.row, p.col"""


@query(
    "G1",
    """SELECT p.row, p.col, round(sqrt(min((p.row - r.row) * (p.row - r.row) + (p.col - r.col) * (p.col - r.col))) * 30, 6) AS distance_m
FROM {px} p CROSS JOIN (SELECT DISTINCT row, col FROM {road_cells} WHERE highway_code <= 7) r GROUP BY p.row, p.col""",
)
def road_distance(t):
    return r6(distance.road_distance(t.roads, t.grid))


@query("G2", "SELECT * FROM {trail_dens}", trail_dens=TRAIL_DENS)
def trail_density(t):
    return distance.trail_density(t.trails, t.grid)


RTC_SQL = "CASE least(fbfm40, 205) " + " ".join(f"WHEN {k} THEN {v}" for k, v in src.RTC.items()) + " ELSE 0 END"


@query(
    "P23 F24",
    f"""SELECT pix, CAST(round_even(100 * (base + CASE WHEN distance_m <= 100 THEN 0 ELSE
    {steps_sql('sp', (10, 20, 30, 40, 50), (0.01, 0.1, 0.2, 0.4, 0.6), 0.8, '<=')} END::DOUBLE), 0) AS SMALLINT) AS sdi
FROM (SELECT *, CASE WHEN flamelength IS NULL THEN NULL ELSE 2.0::DOUBLE * ({FL_CLS}) * ({HUA_CLS}) / (({FL_CLS}) + ({HUA_CLS})) END
   / ({steps_sql('coalesce(distance_m, 1e9)', range(100, 901, 100), DOWN, 1, '<=')} + 1
      + (({SLOPE_CLS}) + rtc + ({ASPECT_CLS}) + 2 * ({steps_sql('coalesce(trail_m, 0)', range(10, 91, 10), UP, 10)})) / 5.0::DOUBLE
      + rtc * (({steps_sql('sp', (20, 30, 40), (1.0, 0.75, 0.625), 0.5)})::DOUBLE + ({steps_sql('sp', (30, 40), (1.0, 0.5), 0.0)})::DOUBLE)) AS base
 FROM (SELECT p.*, distance_m, trail_m, tan(radians(slpd)) * 100 AS sp, {RTC_SQL} AS rtc
  FROM {{px}} p LEFT JOIN {{road_dist}} d USING (row, col) LEFT JOIN {{trail_dens}} USING (row, col)))""",
    road_dist=ROAD_DIST, trail_dens=TRAIL_DENS,
)
def suppression_difficulty(t):
    out = suppression.calculate_sdi(t.px.drop("sdi"), t.roads, t.trails, src.rtc_table(t.spark), t.grid)
    return out.select("pix", "sdi")


# Length of lines within 56.41896 m of a pixel centre, as chords of the circle.
CHORDS = """
SELECT row, col, sum(greatest(0, least(1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a))
    - greatest(0, (-b - sqrt(b * b - 4 * a * c)) / (2 * a))) * sqrt(a)) AS trail_m
FROM (SELECT row, col, dx * dx + dy * dy AS a, 2 * (fx * dx + fy * dy) AS b,
   fx * fx + fy * fy - 56.41896::DOUBLE * 56.41896 AS c
 FROM (SELECT row, col, x2 - x1 AS dx, y2 - y1 AS dy, x1 - (col + 0.5::DOUBLE) * 30 AS fx,
    y1 + (row + 0.5::DOUBLE) * 30 AS fy
  FROM {px} JOIN (SELECT x1, y1, x2, y2 FROM {trails} UNION ALL
    SELECT x1, y1, x2, y2 FROM {roads} WHERE highway_code > 7) l
   ON (col + 0.5::DOUBLE) * 30 BETWEEN least(x1, x2) - 57 AND greatest(x1, x2) + 57
  AND -(row + 0.5::DOUBLE) * 30 BETWEEN least(y1, y2) - 57 AND greatest(y1, y2) + 57))
WHERE b * b - 4 * a * c > 0 GROUP BY row, col"""
SMOOTH_BASE = f"""
SELECT p.*, distance_m, coalesce(trail_m, 0) AS tl, on_line, sp,
  CASE fbfm40 {" ".join(f"WHEN {k} THEN {v}" for k, v in src.RTC.items())} END AS rtc,
  CASE WHEN flamelength IS NULL THEN NULL ELSE 2.0::DOUBLE * ({FL_CLS}) * ({HUA_CLS}) / (({FL_CLS}) + ({HUA_CLS})) END AS energy
FROM {{px}} p LEFT JOIN {{road_dist}} USING (row, col) LEFT JOIN {{chords}} USING (row, col)
LEFT JOIN (SELECT DISTINCT row, col, true AS on_line FROM (SELECT row, col FROM {{road_cells}} UNION ALL
  SELECT row, col FROM {{trail_cells}})) USING (row, col)
LEFT JOIN (SELECT row, col, sqrt(dx * dx + dy * dy) * 100 AS sp FROM (
 SELECT a.row, a.col,
  (({_near(-1, 1)} + 2 * {_near(0, 1)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(0, -1)} + {_near(1, -1)})) / 240.0::DOUBLE AS dx,
  (({_near(1, -1)} + 2 * {_near(1, 0)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(-1, 0)} + {_near(-1, 1)})) / 240.0::DOUBLE AS dy
 FROM {{px}} a JOIN {{px}} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
 GROUP BY a.row, a.col)) USING (row, col)"""
SMOOTH_PEN = f"""
SELECT *, (({SLOPE_CLS}) + rtc + ({ASPECT_CLS}) + 2 * ({steps_sql('tl', range(10, 91, 10), UP, 10)})) / 5.0::DOUBLE AS penetr
FROM {{smooth_base}}"""
SMOOTH_FOCAL = """
SELECT a.row, a.col, avg(b.energy) AS energy_focal, avg(b.penetr) AS penetr_focal
FROM {smooth_pen} a JOIN {smooth_pen} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
GROUP BY a.row, a.col"""


@query(
    "P24 F18",
    f"""SELECT pix, CAST(trunc(100 * CASE WHEN on_line THEN base WHEN fbfm40 = 98 THEN 0
   ELSE base + ({steps_sql('sp', (10, 20, 30, 40, 50), (0.01, 0.1, 0.2, 0.4, 0.6), 0.8)})::DOUBLE END) AS SMALLINT) AS sdi
FROM (SELECT *, CASE WHEN raw IS NULL AND fbfm40 < 100 THEN 0 ELSE raw END AS base FROM (
 SELECT p.*, CASE WHEN fbfm40 > 100 THEN energy_focal ELSE 1 END
   / ({steps_sql('coalesce(distance_m, 1e9)', range(100, 901, 100), DOWN, 1, '<=')} + 1 + penetr_focal
    + rtc * (({steps_sql('sp', (16, 31, 46), (1.0, 0.8, 0.6), 0.5)})::DOUBLE
      + ({steps_sql('sp', (16, 21, 26, 31, 36), (1.0, 0.8, 0.7, 0.6, 0.5), 0.0)})::DOUBLE)) AS raw
 FROM {{smooth_pen}} p JOIN {{smooth_focal}} USING (row, col)))""",
    road_dist=ROAD_DIST, chords=CHORDS, smooth_base=SMOOTH_BASE, smooth_pen=SMOOTH_PEN,
    smooth_focal=SMOOTH_FOCAL,
)
def suppression_difficulty_smoothed(t):
    out = suppression.calculate_sdi_smoothed(
        t.px.drop("sdi"), t.roads, t.trails, src.rtc_table(t.spark), t.grid
    )
    return out.select("pix", "sdi")


@query(
    "G7 J12",
    """SELECT f.fire_id, z.feature_id FROM {fires} f LEFT JOIN (
 SELECT fire_id, feature_id FROM {fires} JOIN {zone_edges}
   ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x
 GROUP BY fire_id, feature_id HAVING count(*) % 2 = 1) z USING (fire_id)""",
)
def points_in_polygons(t):
    return spatial_join.points_in_polygons(
        t.fires.select("fire_id", "x", "y"), t.zone_edges, tile=90.0, point_id="fire_id", how="left"
    ).select("fire_id", "feature_id")


def seg_dist(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2)))"
    return f"sqrt(({px} - {ax} - {t} * ({bx} - {ax})) ** 2 + ({py} - {ay} - {t} * ({by} - {ay})) ** 2)"


PIP = """
SELECT fire_id, feature_id FROM {fires} JOIN {zone_edges}
   ON (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x
 GROUP BY fire_id, feature_id HAVING count(*) % 2 = 1"""


@query(
    "G8",
    f"""SELECT fire_id, feature_id FROM {{pip}} UNION
SELECT fire_id, feature_id FROM {{fires}} JOIN {{zone_edges}}
 ON x BETWEEN least(x1, x2) - 60 AND greatest(x1, x2) + 60 AND y BETWEEN least(y1, y2) - 60 AND greatest(y1, y2) + 60
WHERE {seg_dist('x', 'y', 'x1', 'y1', 'x2', 'y2')} <= 60""",
    pip=PIP,
)
def points_within_distance(t):
    return spatial_join.points_within_distance(
        t.fires.select("fire_id", "x", "y"), t.zone_edges, 60.0, point_id="fire_id"
    ).select("fire_id", "feature_id")


POD_FLAG = f"""
SELECT feature_id, CASE WHEN bool_or(hit) THEN 'Line' ELSE 'Interior' END AS pod_line FROM (
 SELECT z.feature_id, {seg_dist('z.x1', 'z.y1', 'p.x1', 'p.y1', 'p.x2', 'p.y2')} <= 120
   OR {seg_dist('z.x2', 'z.y2', 'p.x1', 'p.y1', 'p.x2', 'p.y2')} <= 120
   OR {seg_dist('p.x1', 'p.y1', 'z.x1', 'z.y1', 'z.x2', 'z.y2')} <= 120
   OR {seg_dist('p.x2', 'p.y2', 'z.x1', 'z.y1', 'z.x2', 'z.y2')} <= 120
   OR (((z.x2 - z.x1) * (p.y1 - z.y1) - (z.y2 - z.y1) * (p.x1 - z.x1)) * ((z.x2 - z.x1) * (p.y2 - z.y1) - (z.y2 - z.y1) * (p.x2 - z.x1)) < 0
     AND ((p.x2 - p.x1) * (z.y1 - p.y1) - (p.y2 - p.y1) * (z.x1 - p.x1)) * ((p.x2 - p.x1) * (z.y2 - p.y1) - (p.y2 - p.y1) * (z.x2 - p.x1)) < 0)
   AS hit FROM {{zone_edges}} z, {{pod_lines}} p
 UNION ALL SELECT feature_id, true FROM (
  SELECT z.feature_id, p.feature_id AS line, p.seq FROM {{zone_edges}} z JOIN {{pod_lines}} p
   ON (z.y1 <= p.y1) <> (z.y2 <= p.y1) AND z.x1 + (p.y1 - z.y1) * (z.x2 - z.x1) / (z.y2 - z.y1) > p.x1
  GROUP BY ALL HAVING count(*) % 2 = 1)) GROUP BY feature_id"""


@query("G9", "SELECT * FROM {pod_flag}", pod_flag=POD_FLAG)
def near_boundary_lines(t):
    return spatial_join.near_line_flag(t.zone_edges, t.pod_lines, 120.0)


def line_dist(source: str, limit: float) -> str:
    d = seg_dist("(col + 0.5::DOUBLE) * 30", "-(row + 0.5::DOUBLE) * 30", "x1", "y1", "x2", "y2")
    return f"""
SELECT feature_id, row, col, min({d}) AS distance_m FROM {{px}} JOIN {{{source}}}
 ON (col + 0.5::DOUBLE) * 30 BETWEEN least(x1, x2) - {limit} AND greatest(x1, x2) + {limit}
AND -(row + 0.5::DOUBLE) * 30 BETWEEN least(y1, y2) - {limit} AND greatest(y1, y2) + {limit}
GROUP BY feature_id, row, col HAVING min({d}) <= {limit}"""


@query(
    "G10 J8",
    """SELECT feature_id, CAST(feet AS INT) AS buffer_ft, count(*) AS cells FROM {dist},
 (SELECT i * 50 AS feet FROM range(1, 13) r(i)) WHERE distance_m <= feet * 0.3048::DOUBLE GROUP BY ALL""",
    dist=line_dist("pod_lines", 182.88),
)
def line_buffer_zones(t):
    feet = [50.0 * i for i in range(1, 13)]
    cells = distance.line_cell_distance(t.pod_lines, t.grid, 600 * 0.3048)
    zones = distance.buffer_zones(cells, [f * 0.3048 for f in feet])
    return zones.groupBy(
        "feature_id", F.rint(F.col("buffer_m") / 0.3048).cast("int").alias("buffer_ft")
    ).agg(F.count("*").alias("cells"))


@query(
    "G23",
    """SELECT row, col, arg_min(feature_id, (round(distance_m, 9), feature_id)) AS feature_id, round(min(distance_m), 6) AS distance_m
FROM {dist} GROUP BY row, col""",
    dist=line_dist("pod_lines", 150.0),
)
def nearest_line_of_cell(t):
    cells = distance.line_cell_distance(t.pod_lines, t.grid, 150.0)
    cells = cells.withColumn("distance_m", F.round("distance_m", 9))
    return r6(distance.nearest_line_cells(cells))


@query(
    "P25",
    """SELECT DISTINCT p.row, p.col, p.sdi FROM {px} p JOIN {dist} d USING (row, col)""",
    dist=line_dist("pod_lines", 91.44),
)
def raster_in_buffers(t):
    cells = distance.line_cell_distance(t.pod_lines, t.grid, 300 * 0.3048)
    return t.px.select("row", "col", "sdi").join(
        cells.select("row", "col").distinct(), ["row", "col"], "left_semi"
    )


AREA = """
SELECT feature_id, sum(CASE ring WHEN 0 THEN 1 ELSE -1 END * abs(a)) AS area_m2 FROM (
 SELECT feature_id, part, ring, sum(x1 * y2 - x2 * y1) / 2 AS a FROM {zone_edges} GROUP BY ALL) GROUP BY feature_id"""


@query(
    "G11 F35",
    """SELECT feature_id, round(area_m2, 6) AS area_m2, round(area_m2 * 0.000247105, 6) AS acres_treatments,
  round(area_m2 / 4046.86, 6) AS acres_spread, round_even(area_m2 / 4046.856, 2)::DOUBLE AS acres_units FROM {area}""",
    area=AREA,
)
def polygon_acres(t):
    a = geometry.polygon_areas(t.zone_edges)
    return r6(
        a.select(
            "feature_id", "area_m2", geometry.acres("area_m2").alias("acres_treatments"),
            geometry.acres("area_m2", "spread").alias("acres_spread"),
            geometry.acres("area_m2", "units").alias("acres_units"),
        )
    )


@query(
    "G11",
    """SELECT 'zones' AS unit_name, CAST(feature_id AS STRING) AS unit_id,
  round_even(area_m2 / 4046.856, 2)::DOUBLE AS unit_acres FROM {area}
UNION ALL SELECT 'whole', 'whole', round_even(sum(area_m2) / 4046.856, 2)::DOUBLE FROM {area}""",
    area=AREA,
)
def acres_of_units(t):
    a = geometry.polygon_areas(t.zone_edges)
    whole = a.select(F.lit("whole").alias("unit_name"), F.lit(None).cast("string").alias("unit_id"), "area_m2")
    named = a.select(F.lit("zones").alias("unit_name"), F.col("feature_id").cast("string").alias("unit_id"), "area_m2")
    return geometry.unit_acres(named.unionByName(whole))


@query(
    "G12",
    """SELECT feature_id, round(sum(s * mx) / (6 * sum(s * a)), 4) AS cx, round(sum(s * my) / (6 * sum(s * a)), 4) AS cy FROM (
 SELECT *, CASE ring WHEN 0 THEN 1 ELSE -1 END * sign(a) AS s FROM (
  SELECT feature_id, part, ring, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx,
   sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM {zone_edges} GROUP BY ALL)) GROUP BY feature_id""",
)
def polygon_centroids(t):
    return r6(geometry.centroids(t.zone_edges), digits=4)


SHARED = """
SELECT feature_id, region_id, count(*) AS cells FROM {zone_cells} JOIN {region_cells} USING (row, col) GROUP BY ALL"""


def _region_spans(t):
    return rasterize.polygon_spans(t.region_edges, t.grid, ["region_id"])


def _zone_spans(t):
    return rasterize.polygon_spans(t.zone_edges, t.grid)


@query(
    "G13 K7",
    "SELECT feature_id, arg_min(region_id, (-cells, region_id)) AS region_id, max(cells) AS overlap_cells FROM {shared} GROUP BY feature_id",
    shared=SHARED,
)
def dominant_regions(t):
    return overlap.dominant_region(_zone_spans(t), _region_spans(t))


@query(
    "G14",
    """SELECT a.feature_id, region_id, round(n * 900 * 0.000247105::DOUBLE, 6) AS overlap_acres
FROM {zone_attr} a LEFT JOIN (
 SELECT feature_id, arg_min(region_id, (-cells, region_id)) AS region_id, max(cells) AS n FROM {shared} GROUP BY feature_id
 ) b ON a.feature_id = b.feature_id
 AND n / (SELECT count(*)::DOUBLE FROM {region_cells} r WHERE r.region_id = b.region_id) >= 0.02""",
    shared=SHARED,
)
def majority_regions(t):
    return r6(
        overlap.assign_majority(
            t.zone_attr.select("feature_id"), _zone_spans(t), _region_spans(t), t.grid, thresh=0.02
        )
    )


@query(
    "G15",
    f"""SELECT feature_id, round(count(*) FILTER (WHERE near IS NULL AND aoi) / count(*)::DOUBLE, 6) AS unit_pct
FROM (SELECT z.*, d.row AS near, z.row // 40 = 0 AND z.col < 50 AS aoi FROM {{zone_cells}} z
 LEFT JOIN {{rim}} d USING (feature_id, row, col)) GROUP BY feature_id
HAVING count(*) FILTER (WHERE near IS NULL AND aoi) / count(*)::DOUBLE >= 0.5""",
    rim=line_dist("zone_edges", 10.0).replace("<= 10.0", "< 10.0"),
)
def units_by_region(t):
    aoi = _region_spans(t).where(F.col("region_id").isin(0, 1))
    return r6(overlap.extract_by_region(t.zone_edges, aoi, t.grid, shrink_m=10.0))


@query(
    "G16",
    """SELECT a_id, b_id, round(CASE WHEN least(na, nb) > 0 THEN n / least(na, nb)::DOUBLE ELSE 0 END, 6) AS fraction FROM (
 SELECT a.feature_id AS a_id, b.feature_id AS b_id,
  (SELECT count(*) FROM {zone_cells} x JOIN {zone_cells} y USING (row, col) WHERE x.feature_id = a.feature_id AND y.feature_id = b.feature_id) AS n,
  (SELECT count(*) FROM {zone_cells} x WHERE x.feature_id = a.feature_id) AS na,
  (SELECT count(*) FROM {zone_cells} x WHERE x.feature_id = b.feature_id) AS nb
 FROM {zone_attr} a JOIN {zone_attr} b ON b.feature_id BETWEEN a.feature_id + 1 AND a.feature_id + 3)""",
)
def overlap_fractions(t):
    ids = t.zone_attr.select("feature_id")
    step = ids.withColumn("_d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        F.col("feature_id").alias("a_id"), (F.col("feature_id") + F.col("_d")).alias("b_id")
    )
    pairs = step.join(ids.withColumnRenamed("feature_id", "b_id"), "b_id", "left_semi")
    spans = _zone_spans(t)
    return r6(overlap.min_overlap_fraction(pairs, spans, spans))


@query(
    "G17",
    "SELECT DISTINCT type, row, col FROM {zone_cells} JOIN {zone_attr} USING (feature_id)",
)
def dissolved_by_type(t):
    typed = _zone_spans(t).join(t.zone_attr.select("feature_id", "type"), "feature_id")
    return rasterize.span_cells(rasterize.dissolve_spans(typed, ["type"]))


EFFECTS = """
SELECT row, col, CASE feature_id % 4 WHEN 0 THEN 'Hand Thin' WHEN 1 THEN 'Mech Thin' WHEN 2 THEN 'RxFire' ELSE 'Masticate' END AS eff
FROM {zone_cells}"""


def _effect_spans(t, name, labels):
    pick = F.get(F.array(*[F.lit(x) for x in labels]), (F.col("feature_id") % len(labels)).cast("int"))
    return rasterize.dissolve_spans(_zone_spans(t).withColumn(name, pick), [name])


@query(
    "G18",
    """SELECT row, col, unnest(list_filter([CASE WHEN h AND r THEN 'Complete Hand' END,
  CASE WHEN m AND r AND NOT h THEN 'Complete Mech' END, CASE WHEN r AND NOT h AND NOT m THEN 'RxFire' END,
  CASE WHEN m AND (NOT r OR h) THEN 'Mech Thin' END, CASE WHEN h AND NOT r AND NOT m THEN 'Hand Thin' END,
  CASE WHEN k THEN 'Masticate' END], lambda x: x IS NOT NULL)) AS can_eff FROM (
 SELECT row, col, bool_or(eff = 'Hand Thin') AS h, bool_or(eff = 'Mech Thin') AS m, bool_or(eff = 'RxFire') AS r,
  bool_or(eff = 'Masticate') AS k FROM {effects} GROUP BY row, col)""",
    effects=EFFECTS,
)
def canopy_overlay(t):
    return overlap.flatten_canopy(
        _effect_spans(t, "can_eff", ("Hand Thin", "Mech Thin", "RxFire", "Masticate"))
    )


@query(
    "G19",
    """SELECT row, col, CASE min(CASE feature_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)
  WHEN 0 THEN 'RxFire' WHEN 1 THEN 'Manage' ELSE 'Rearrange' END AS surf_eff FROM {zone_cells} GROUP BY row, col""",
)
def surface_overlay(t):
    return overlap.flatten_surface(_effect_spans(t, "surf_eff", ("Rearrange", "Manage", "RxFire")))


@query(
    "G20",
    """SELECT feature_id, part, ring, count(*) AS n FROM {zone_edges} WHERE NOT (feature_id % 5 = 3 AND seq = 2)
GROUP BY ALL HAVING count(*) >= 3 AND sum(x1 * y2 - x2 * y1) <> 0
 AND list_sort(list((x1, y1))) = list_sort(list((x2, y2)))""",
)
def valid_rings(t):
    broken = t.zone_edges.where(~((F.col("feature_id") % 5 == 3) & (F.col("seq") == 2)))
    return geometry.valid_rings(broken).groupBy("feature_id", "part", "ring").agg(F.count("*").alias("n"))


# Copies of every zone: reversed, shifted by a fraction of the snapping grid, moved by a metre.
COPIES = """
SELECT feature_id, 0 AS copy, x1, y1, x2, y2 FROM {zone_edges}
UNION ALL SELECT feature_id + 10000000, 1, x2, y2, x1, y1 FROM {zone_edges}
UNION ALL SELECT feature_id + 20000000, 2, x1 + 0.001, y1, x2 + 0.001, y2 FROM {zone_edges}
UNION ALL SELECT feature_id + 30000000, 3, x1 + 1, y1, x2 + 1, y2 FROM {zone_edges}"""


@query(
    "G21",
    """SELECT min(feature_id) AS feature_id, count(*) AS n_copies FROM (
 SELECT feature_id, list_sort(list(list_sort([(round_even(x1 / 0.01, 0)::BIGINT, round_even(y1 / 0.01, 0)::BIGINT),
   (round_even(x2 / 0.01, 0)::BIGINT, round_even(y2 / 0.01, 0)::BIGINT)]))) AS k FROM {copies} GROUP BY feature_id) GROUP BY k""",
    copies=COPIES,
)
def distinct_geometries(t):
    z = t.zone_edges
    s = lambda i, a, b, c, d: z.select(
        (F.col("feature_id") + i * 10000000).alias("feature_id"), a.alias("x1"), b.alias("y1"),
        c.alias("x2"), d.alias("y2"),
    )
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    copies = (
        s(0, x1, y1, x2, y2).unionByName(s(1, x2, y2, x1, y1))
        .unionByName(s(2, x1 + 0.001, y1, x2 + 0.001, y2))
        .unionByName(s(3, x1 + 1, y1, x2 + 1, y2))
    )
    return geometry.drop_duplicate_geometries(copies).drop("geom_key")


SEGMENTS = """
SELECT *, sum(len) OVER (PARTITION BY feature_id ORDER BY seq) - len AS s0, sum(len) OVER (PARTITION BY feature_id ORDER BY seq) AS s1
FROM (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM {pod_lines})"""


@query(
    "G22",
    """SELECT feature_id, k AS segment, count(*) AS n_edges, round(sum(least(s1, (k + 1) * 100.0::DOUBLE) - greatest(s0, k * 100.0::DOUBLE)), 4) AS length,
  round(min(x1 + (greatest(s0, k * 100.0::DOUBLE) - s0) / len * (x2 - x1)), 4) AS first_x
FROM {segments}, range(0, 8) r(k) WHERE least(s1, (k + 1) * 100.0::DOUBLE) > greatest(s0, k * 100.0::DOUBLE) GROUP BY ALL""",
    segments=SEGMENTS,
)
def split_boundary_lines(t):
    pieces = lines.split_lines(t.pod_lines, 100.0)
    return pieces.groupBy("feature_id", "segment").agg(
        F.count("*").alias("n_edges"), F.round(F.sum("length"), 4).alias("length"),
        F.round(F.min("x1"), 4).alias("first_x"),
    )


@query(
    "G25",
    """SELECT s.feature_id AS segment_id, zone_id, type FROM (SELECT DISTINCT feature_id FROM {pod_lines}) s
LEFT JOIN (SELECT segment_id, arg_min(zone_id, (-round(len, 6), zone_id)) AS zone_id FROM (
  SELECT segment_id, zone_id, sum(l * (hi - lo)) AS len FROM (
   SELECT p.feature_id AS segment_id, z.feature_id AS zone_id, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l,
    greatest(0, least((30 * z.col - x1) / (x2 - x1), (30 * (z.col + 1) - x1) / (x2 - x1)),
      least((-30 * z.row - y1) / (y2 - y1), (-30 * (z.row + 1) - y1) / (y2 - y1))) AS lo,
    least(1, greatest((30 * z.col - x1) / (x2 - x1), (30 * (z.col + 1) - x1) / (x2 - x1)),
      greatest((-30 * z.row - y1) / (y2 - y1), (-30 * (z.row + 1) - y1) / (y2 - y1))) AS hi
   FROM {pod_lines} p, {zone_grid} z) WHERE hi > lo GROUP BY ALL) GROUP BY segment_id) b ON b.segment_id = s.feature_id
LEFT JOIN {zone_attr} a ON a.feature_id = b.zone_id""",
)
def zone_of_line(t):
    zones = rasterize.zone_pixels(_zone_spans(t), t.zone_attr).withColumnRenamed("feature_id", "zone_id")
    attrs = t.zone_attr.select(F.col("feature_id").alias("zone_id"), "type")
    edges = t.pod_lines.withColumnRenamed("feature_id", "segment_id")
    segs = edges.select("segment_id").distinct()
    out = lines.largest_overlap_join(segs, edges, zones, attrs, t.grid)
    return out.select("segment_id", "zone_id", "type")


@query("G24")
def eliminated_zones(t):
    zones = rasterize.zone_pixels(_zone_spans(t), t.zone_attr).withColumnRenamed("feature_id", "zone_id")
    merged = lines.eliminate_small_zones(zones, t.grid, min_acres=6.0)
    return merged.groupBy("zone_id").agg(F.count("*").alias("cells"))


@query(
    "G27",
    """SELECT feature_id, minx, miny, maxx, maxy FROM (
 SELECT feature_id, min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx,
  max(greatest(y1, y2)) AS maxy FROM {zone_edges} GROUP BY feature_id)
WHERE maxx >= 500 AND minx <= 1800 AND maxy >= -3000 AND miny <= -100 AND feature_id % 10 IN (1, 7)""",
)
def features_in_box(t):
    boxes = geometry.bounding_boxes(t.zone_edges).withColumn(
        "statefp", F.lpad((F.col("feature_id") % 10).cast("string"), 2, "0")
    )
    return geometry.intersecting_box(boxes, (500, -3000, 1800, -100), ["1", 7]).drop("statefp")


@query(
    "G28",
    """SELECT kind, highway, CAST(code AS INT) AS code, count(*) AS n FROM (
 SELECT 'road' AS kind, highway, c AS code FROM {raw_roads} WHERE c <= 9
 UNION ALL SELECT 'trail', highway, NULL FROM {raw_roads} WHERE highway IN ('path', 'footway', 'track')) GROUP BY ALL""",
    raw_roads="""SELECT *, CASE highway WHEN 'motorway' THEN 1 WHEN 'primary' THEN 3 WHEN 'residential' THEN 7
  WHEN 'track' THEN 9 ELSE 99 END AS c FROM (
 SELECT osmid, arg_min(highway, chunk) AS highway FROM (
  SELECT c_custkey // 3 AS osmid, c_custkey % 3 AS chunk, CASE c_nationkey % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary'
   WHEN 2 THEN 'residential' WHEN 3 THEN 'track' WHEN 4 THEN 'path' WHEN 5 THEN 'footway' ELSE 'steps' END AS highway
  FROM {customer}) GROUP BY osmid)""",
)
def road_normalisation(t):
    kinds = ["motorway", "primary", "residential", "track", "path", "footway", "steps"]
    raw = t.customer.select(
        F.lit("way").alias("element"), F.floor(F.col("c_custkey") / 3).alias("osmid"),
        (F.col("c_custkey") % 3).alias("chunk"),
        F.array(F.get(F.array(*[F.lit(k) for k in kinds]), F.col("c_nationkey") % 7), F.lit("x")).alias("highway"),
    )
    roads, trails = geometry.normalise_roads(raw)
    both = roads.select(F.lit("road").alias("kind"), "highway", F.col("highway_code").alias("code")).unionByName(
        trails.select(F.lit("trail").alias("kind"), "highway", F.lit(None).cast("int").alias("code"))
    )
    return both.groupBy("kind", "highway", "code").agg(F.count("*").alias("n"))


@query(
    "G30",
    """SELECT fire_id, gid, CAST(rank AS INT) AS rank, round(d, 9) AS distance_deg FROM (
 SELECT fire_id, gid, d, row_number() OVER (PARTITION BY fire_id ORDER BY d, gid) AS rank FROM (
  SELECT f.fire_id, l.gid, sqrt((f.lon - (l.lon - 360)) ** 2 + (f.lat - l.lat) ** 2) AS d
  FROM (SELECT fire_id, lon, lat FROM {fires} UNION ALL SELECT -1, -60.5::DOUBLE, 12.25::DOUBLE) f CROSS JOIN {lattice} l))
WHERE rank <= 9""",
)
def nearest_wind_points(t):
    fires = t.fires.select("fire_id", "lon", "lat")
    far = t.spark.createDataFrame([(-1, -60.5, 12.25)], "fire_id long, lon double, lat double")
    out = spatial_join.nearest_grid_points(
        fires.union(far.select([far[f.name].cast(f.dataType) for f in fires.schema])), t.lattice, k=9, bucket_deg=0.1, point_id="fire_id"
    )
    return out.select("fire_id", "gid", "rank", F.round("distance_deg", 9).alias("distance_deg"))


@query(
    "G31",
    """SELECT feature_id, round_even(count(bp) * 900 / 4046.86::DOUBLE, 2) AS acres_gis
FROM {px} JOIN {zone_touched} USING (row, col) GROUP BY feature_id""",
)
def clipped_zone_acres(t):
    spans = rasterize.touched_spans(t.zone_edges, t.grid)
    zoned = rasterize.join_pixels(t.px.select("row", "col", "bp"), spans)
    return zonal.zone_clip_area(zoned, "bp", CELL)

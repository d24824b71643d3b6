"""Grid-free overlay, repair, dissolve and offset; the checking SQL cuts polygons into vertical slabs instead.

A slab has no vertex and no crossing inside, so every interval of a polygon along its middle times the slab's
width is an exact area.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from firegrid.operators import arrangement, offset, overlay, planar

from .registry import query, r6
from .views import VIEWS, Branches

TILE = 240.0

# One figure per supplier with what rings do wrong: a bow-tie, overlapping parts, a ring run through twice
# (every fifth), a spike (every fourth), and a ring that is no area (every third).
_FIGURES = (
    ("true", 0, (("0", "0"), ("4 + s % 3", "4"), ("4 + s % 3", "0"), ("0", "4"))),
    ("true", 1, (("1", "1"), ("3 + s % 2", "1"), ("3", "3"), ("1", "3.5"))),
    ("s % 5 = 0", 2, (("1", "1"), ("3 + s % 2", "1"), ("3", "3"), ("1", "3.5"))),
    ("s % 4 = 0", 3, (("8", "0"), ("10", "0"), ("14", "0"), ("10", "0"), ("10", "2"))),
    ("s % 3 = 0", 4, (("8", "8"), ("9", "9"), ("10", "10"))),
)
VIEWS["messy_edges"] = Branches("zone_base", tuple(
    (cond, {
        "feature_id": "s", "part": str(part), "ring": "0", "seq": str(i),
        "x1": f"CAST((u + {a[0]}) * 30 AS DOUBLE)", "y1": f"CAST(-(w + {a[1]}) * 30 AS DOUBLE)",
        "x2": f"CAST((u + {b[0]}) * 30 AS DOUBLE)", "y2": f"CAST(-(w + {b[1]}) * 30 AS DOUBLE)",
    })
    for cond, part, corners in _FIGURES
    for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))
))


def flat_sql(view: str, group: str, feature: str, where: str = "true") -> str:
    """Edges from left to right; upright ones bound no interval."""
    return f"""
SELECT {group} AS g, {feature} AS k, part, ring, CASE ring WHEN 0 THEN 1.0::DOUBLE ELSE -1 END AS s, least(x1, x2) AS ax,
 CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS ay, greatest(x1, x2) AS bx, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS b_y
FROM {view} WHERE x1 <> x2 AND {where}"""


_SLOPE = "({0}.b_y - {0}.ay) / ({0}.bx - {0}.ax)"
_CROSS = f"(b.ay - a.ay + a.ax * ({_SLOPE.format('a')}) - b.ax * ({_SLOPE.format('b')})) / ({_SLOPE.format('a')} - {_SLOPE.format('b')})"
_AT = "e.ay + (xm - e.ax) * (e.b_y - e.ay) / (e.bx - e.ax)"


def shared_views(left: str, right: str) -> dict[str, str]:
    """``shared_m2`` (lk, rk, m2) from two flat edge views; intervals are taken ring by ring, holes count negatively."""
    box = "SELECT k, min(ax) AS x0, max(bx) AS x1, min(least(ay, b_y)) AS y0, max(greatest(ay, b_y)) AS y1 FROM {%s} GROUP BY k"
    intervals = """
SELECT lk, rk, xm, h, part, ring, s, min(y) AS lo, max(y) AS hi FROM (
 SELECT *, row_number() OVER (PARTITION BY lk, rk, xm, part, ring ORDER BY y) - 1 AS n FROM (
  SELECT m.*, e.part, e.ring, e.s, %s AS y FROM {sh_mid} m JOIN {%s} e ON e.k = m.%s AND e.ax < xm AND xm < e.bx))
GROUP BY lk, rk, xm, h, part, ring, s, n // 2"""
    return {
        "sh_l": left, "sh_r": right, "sh_lbox": box % "sh_l", "sh_rbox": box % "sh_r",
        "sh_pair": """SELECT l.k AS lk, r.k AS rk, greatest(l.x0, r.x0) AS x0, least(l.x1, r.x1) AS x1 FROM {sh_lbox} l JOIN {sh_rbox} r
 ON l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1""",
        "sh_x": f"""
SELECT DISTINCT lk, rk, x FROM (
 SELECT *, unnest([x0, x1]) AS x FROM {{sh_pair}}
 UNION ALL SELECT p.*, unnest([ax, bx]) AS x FROM {{sh_pair}} p JOIN {{sh_l}} ON k = lk
 UNION ALL SELECT p.*, unnest([ax, bx]) AS x FROM {{sh_pair}} p JOIN {{sh_r}} ON k = rk
 UNION ALL SELECT p.*, {_CROSS} AS x FROM {{sh_pair}} p JOIN {{sh_l}} a ON a.k = lk JOIN {{sh_r}} b ON b.k = rk
  AND a.ax < b.bx AND b.ax < a.bx AND {_SLOPE.format('a')} <> {_SLOPE.format('b')})
WHERE x BETWEEN x0 AND x1""",
        "sh_mid": """SELECT lk, rk, (x + nx) / 2 AS xm, nx - x AS h FROM (
 SELECT *, lead(x) OVER (PARTITION BY lk, rk ORDER BY x) AS nx FROM {sh_x}) WHERE nx > x""",
        "sh_li": intervals % (_AT, "sh_l", "lk"), "sh_ri": intervals % (_AT, "sh_r", "rk"),
        "shared_m2": """
SELECT * FROM (SELECT l.lk, l.rk, sum(l.s * r.s * l.h * greatest(0, least(l.hi, r.hi) - greatest(l.lo, r.lo))) AS m2
 FROM {sh_li} l JOIN {sh_ri} r USING (lk, rk, xm) GROUP BY l.lk, l.rk) WHERE m2 > 1e-6""",
    }


def union_views(edges: str, more_x: str = "SELECT g, ax AS x FROM {un_e}") -> dict[str, str]:
    """``un_run`` (g, xm, h, lo, hi): the disjoint intervals of the union of a group's features, each of them inside where
    an odd number of its edges lies below. ``more_x`` adds places to cut at."""
    return {
        "un_e": edges,
        "un_x": f"""
SELECT DISTINCT g, x FROM (SELECT g, unnest([ax, bx]) AS x FROM {{un_e}} UNION ALL {more_x}
 UNION ALL SELECT a.g, {_CROSS} AS x FROM {{un_e}} a JOIN {{un_e}} b ON a.g = b.g AND a.ax < b.bx AND b.ax < a.bx
  AND least(a.ay, a.b_y) <= greatest(b.ay, b.b_y) AND least(b.ay, b.b_y) <= greatest(a.ay, a.b_y)
  AND {_SLOPE.format('a')} > {_SLOPE.format('b')})""",
        "un_mid": """SELECT g, (x + nx) / 2 AS xm, nx - x AS h FROM (
 SELECT *, lead(x) OVER (PARTITION BY g ORDER BY x) AS nx FROM {un_x}) WHERE nx > x""",
        "un_int": f"""
SELECT g, k, xm, h, min(y) AS lo, max(y) AS hi FROM (
 SELECT *, row_number() OVER (PARTITION BY g, k, xm ORDER BY y) - 1 AS n FROM (
  SELECT m.*, e.k, {_AT} AS y FROM {{un_mid}} m JOIN {{un_e}} e ON e.g = m.g AND e.ax < xm AND xm < e.bx))
GROUP BY g, k, xm, h, n // 2""",
        "un_run": """
SELECT g, xm, h, greatest(lo, coalesce(max(hi) OVER (PARTITION BY g, xm ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS lo, hi
FROM {un_int}""",
    }


ZONES = flat_sql("{zone_edges}", "0", "feature_id")
REGIONS = flat_sql("{region_edges}", "0", "region_id")
AREAS = """
SELECT {0} AS k, sum(CASE ring WHEN 0 THEN a ELSE -a END) AS m2 FROM (
 SELECT {0}, part, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM {{{1}}} GROUP BY {0}, part, ring) GROUP BY {0}"""
ZONE_AREAS, REGION_AREAS = AREAS.format("feature_id", "zone_edges"), AREAS.format("region_id", "region_edges")


@query("G13 G25 J12", "SELECT lk AS feature_id, rk AS region_id, round(m2, 4) AS area_m2 FROM {shared_m2}", **shared_views(ZONES, REGIONS))
def overlay_areas(t):
    return r6(overlay.overlay_areas(t.zone_edges, t.region_edges, TILE), digits=4)


@query(
    "G13 K7",
    "SELECT lk AS feature_id, arg_min(rk, (-round(m2, 6), rk)) AS region_id, round(max(m2), 4) AS overlap_m2 FROM {shared_m2} GROUP BY lk",
    **shared_views(ZONES, REGIONS),
)
def dominant_regions_exact(t):
    return r6(overlay.dominant_region(t.zone_edges, t.region_edges, TILE), digits=4)


@query(
    "G14",
    """SELECT a.feature_id, region_id, round(n * 0.000247105::DOUBLE, 6) AS overlap_acres
FROM {zone_attr} a LEFT JOIN (
 SELECT lk, arg_min(rk, (-round(m2, 6), rk)) AS region_id, max(m2) AS n FROM {shared_m2} GROUP BY lk
 ) b ON a.feature_id = lk AND n >= 0.02::DOUBLE * (SELECT m2 FROM {region_m2} r WHERE r.k = b.region_id)""",
    region_m2=REGION_AREAS, **shared_views(ZONES, REGIONS),
)
def majority_regions_exact(t):
    return r6(overlay.assign_majority(t.zone_attr.select("feature_id"), t.zone_edges, t.region_edges, TILE, thresh=0.02))


RECTANGLES = "SELECT region_id, min(x1) + 2 AS x0, max(x1) - 2 AS x1, min(y1) + 2 AS y0, max(y1) - 2 AS y1 FROM {region_edges} GROUP BY region_id"
NEAR_EDGES = "(SELECT z.*, r.region_id FROM {zone_edges} z JOIN {zone_attr} USING (feature_id), {shrunk} r WHERE type = 'Rx Fire')"
MORE_X = """
SELECT e.g, unnest([r.x0, r.x1, CASE WHEN ay <> b_y THEN ax + (r.y0 - ay) / (b_y - ay) * (bx - ax) END,
 CASE WHEN ay <> b_y THEN ax + (r.y1 - ay) / (b_y - ay) * (bx - ax) END]) AS x FROM {un_e} e JOIN {shrunk} r ON r.region_id = e.g"""


@query(
    "G15 G17",
    """SELECT region_id, round(m2 / (x1 - x0 + 4) / (y1 - y0 + 4), 6) AS unit_pct FROM (
 SELECT r.*, (SELECT sum(h * greatest(0, least(hi, y1) - greatest(lo, y0))) FROM {un_run} WHERE g = region_id AND xm BETWEEN x0 AND x1) AS m2
 FROM {shrunk} r) WHERE m2 / (x1 - x0 + 4) / (y1 - y0 + 4) >= 0.005""",
    shrunk=RECTANGLES, **union_views(flat_sql(NEAR_EDGES, "region_id", "feature_id"), MORE_X),
)
def units_by_region_exact(t):
    burned = t.zone_attr.where("type = 'Rx Fire'").select("feature_id")
    return r6(overlay.extract_by_region(t.region_edges, t.zone_edges.join(burned, "feature_id"), TILE, "region_id", thresh=0.005))


@query(
    "G16",
    """SELECT a.feature_id AS a_id, b.feature_id AS b_id, round(coalesce(m2 / least(
  (SELECT m2 FROM {zone_m2} z WHERE z.k = a.feature_id), (SELECT m2 FROM {zone_m2} z WHERE z.k = b.feature_id)), 0), 6) AS fraction
FROM {zone_attr} a JOIN {zone_attr} b ON b.feature_id BETWEEN a.feature_id + 1 AND a.feature_id + 3
LEFT JOIN {shared_m2} ON lk = a.feature_id AND rk = b.feature_id""",
    zone_m2=ZONE_AREAS, **shared_views(ZONES, ZONES),
)
def overlap_fractions_exact(t):
    ids = t.zone_attr.select("feature_id")
    step = ids.withColumn("_d", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        F.col("feature_id").alias("a_id"), (F.col("feature_id") + F.col("_d")).alias("b_id")
    )
    pairs = step.join(ids.withColumnRenamed("feature_id", "b_id"), "b_id", "left_semi")
    return r6(overlay.min_overlap_fraction(pairs, t.zone_edges, t.zone_edges, TILE))


# Lines are cut at every edge they cross; the middle of a stretch tells whether it is inside.
INSIDE = {
    "li_pair": """
SELECT p.feature_id AS line, p.seq AS pseq, p.x1 AS px, p.y1 AS py, p.x2 - p.x1 AS dx, p.y2 - p.y1 AS dy, z.* FROM {pod_lines} p JOIN {li_z} z
 ON least(p.x1, p.x2) < z.x1 AND z.x0 < greatest(p.x1, p.x2) AND least(p.y1, p.y2) < z.y1 AND z.y0 < greatest(p.y1, p.y2)""",
    "li_z": "SELECT feature_id AS zone, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM {zone_edges} GROUP BY feature_id",
    "li_t": """
SELECT DISTINCT line, pseq, zone, px, py, dx, dy, t FROM (
 SELECT *, unnest([0::DOUBLE, 1]) AS t FROM {li_pair}
 UNION ALL SELECT p.*, ((e.x1 - px) * (e.y2 - e.y1) - (e.y1 - py) * (e.x2 - e.x1)) / (dx * (e.y2 - e.y1) - dy * (e.x2 - e.x1)) AS t
 FROM {li_pair} p JOIN {zone_edges} e ON e.feature_id = zone AND dx * (e.y2 - e.y1) - dy * (e.x2 - e.x1) <> 0) WHERE t BETWEEN 0 AND 1""",
    "li_m": """
SELECT *, px + (t + nt) / 2 * dx AS mx, py + (t + nt) / 2 * dy AS my FROM (
 SELECT *, lead(t) OVER (PARTITION BY line, pseq, zone ORDER BY t) AS nt FROM {li_t}) WHERE nt > t""",
    "li_len": """
SELECT line, zone, sum((nt - t) * sqrt(dx * dx + dy * dy)) AS len FROM (
 SELECT m.*, count(*) AS n FROM {li_m} m JOIN {zone_edges} e ON e.feature_id = zone AND least(e.x1, e.x2) <= mx AND mx < greatest(e.x1, e.x2)
  AND e.y1 + (mx - e.x1) / (e.x2 - e.x1) * (e.y2 - e.y1) > my GROUP BY ALL) WHERE n % 2 = 1 GROUP BY line, zone HAVING len > 1e-6""",
}


@query(
    "G25 J12",
    "SELECT line AS segment_id, arg_min(zone, (-round(len, 6), zone)) AS zone_id, round(max(len), 4) AS length_m FROM {li_len} GROUP BY line",
    **INSIDE,
)
def zone_of_line_exact(t):
    segments = t.pod_lines.withColumnRenamed("feature_id", "segment_id")
    zones = t.zone_edges.withColumnRenamed("feature_id", "zone_id")
    return r6(overlay.longest_zone(segments, zones, TILE), digits=4)


@query(
    "G20",
    "SELECT g AS feature_id, round(sum(h * (hi - lo)), 4) AS area_m2 FROM {un_run} WHERE hi > lo GROUP BY g",
    **union_views(flat_sql("{messy_edges}", "feature_id", "feature_id")),
)
def repaired_areas(t):
    return r6(planar.directed_areas(arrangement.make_valid(t.messy_edges, TILE), ["feature_id"]), digits=4)


TYPED_EDGES = "(SELECT * FROM {zone_edges} JOIN {zone_attr} USING (feature_id))"


@query(
    "G17 G10",
    "SELECT g AS type, round(sum(h * (hi - lo)), 4) AS area_m2, 0 AS breaks FROM {un_run} WHERE hi > lo GROUP BY g",
    **union_views(flat_sql(TYPED_EDGES, "type", "feature_id")),
)
def dissolved_polygons(t):
    """Union per type as rings: their area, and how often a ring's edge doesn't begin where the one before ended."""
    merged = arrangement.dissolve(t.zone_edges, t.zone_attr.select("feature_id", "type"), TILE)
    rings = arrangement.polygon_rings(merged, TILE, ["type"])
    after = [F.col(c).alias(f"_{c}") for c in ("x1", "y1")]
    size = rings.groupBy("type", "part", "ring").agg(F.count(F.lit(1)).alias("_n"))
    before = rings.join(size, ["type", "part", "ring"]).withColumn("seq", (F.col("seq") + 1) % F.col("_n"))
    ahead = rings.select("type", "part", "ring", "seq", *after)
    broken = F.coalesce((F.col("x2") != F.col("_x1")) | (F.col("y2") != F.col("_y1")), F.lit(True))
    breaks = before.join(ahead, ["type", "part", "ring", "seq"], "left").groupBy("type").agg(F.count_if(broken).cast("int").alias("breaks"))
    areas = r6(planar.directed_areas(rings, ["type"]), digits=4)
    return areas.join(breaks, "type")


@query(
    "G8 G15",
    """SELECT region_id, round((x1 - x0 + 2 * d) * (y1 - y0 + 2 * d) - CASE WHEN d > 0 THEN d * d * (4 - 32 * sin(pi() / 32)) ELSE 0 END, 4) AS area_m2, d AS distance_m
FROM (SELECT region_id, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM {region_edges} GROUP BY region_id),
 (SELECT unnest([-2.0::DOUBLE, 45.0]) AS d)""",
)
def offset_areas(t):
    """Areas of the regions shrunk by 2 m and grown by 45 m with round corners."""
    done = [
        planar.directed_areas(offset.offset_polygons(t.region_edges, d, TILE, ["region_id"]), ["region_id"]).withColumn("distance_m", F.lit(d))
        for d in (-2.0, 45.0)
    ]
    return r6(done[0].unionByName(done[1]), "area_m2", digits=4)

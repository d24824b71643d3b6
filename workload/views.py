"""Domain tables derived from the driver's tables.

One SQL text per view, run by Spark and (as a CTE) by the checking engine; both understand it,
except that integer division is written ``DIV`` and replaced for the checker. ``{name}`` refers
to a table or another view.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from firegrid import Grid, tune

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

CELL = 30.0
NCOLS = 100

VIEWS: dict[str, "str | Branches"] = {}


@dataclass(frozen=True)
class Branches:
    """Several rows per source row. Spark expands one scan with ``inline``; the checker gets a
    UNION ALL of one SELECT per branch."""

    source: str
    rows: tuple[tuple[str | None, dict[str, str]], ...]

    def spark_sql(self) -> str:
        def struct(cond: str | None, cols: dict[str, str]) -> str:
            body = ", ".join(f"'{n}', {e}" for n, e in cols.items())
            return f"CASE WHEN {cond or 'true'} THEN named_struct({body}) END"

        items = ",\n".join(struct(c, cols) for c, cols in self.rows)
        return f"SELECT inline(filter(array({items}), s -> s IS NOT NULL)) FROM {{{self.source}}}"

    def union_sql(self) -> str:
        def select(cond: str | None, cols: dict[str, str]) -> str:
            body = ", ".join(f"{e} AS {n}" for n, e in cols.items())
            return f"SELECT {body} FROM {{{self.source}}}" + (f" WHERE {cond}" if cond else "")

        return "\nUNION ALL\n".join(select(c, cols) for c, cols in self.rows)


def _fuel_code(i: str) -> str:
    return (
        f"CASE WHEN {i} < 9 THEN 101 + {i} WHEN {i} < 13 THEN 112 + {i} "
        f"WHEN {i} < 22 THEN 128 + {i} WHEN {i} < 27 THEN 139 + {i} "
        f"WHEN {i} < 36 THEN 154 + {i} WHEN {i} < 41 THEN 165 + {i} "
        f"WHEN {i} = 41 THEN 91 ELSE 98 END"
    )


# Landscape: one pixel per order on a grid 100 columns wide. Every 97th flame length, every 89th
# crown state and every 83rd burn probability is missing.
VIEWS["px"] = f"""
SELECT CAST(o_orderkey DIV 100 AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
  CAST(((o_orderkey DIV 100) * 11 + (o_orderkey % 100) * 17) % 400 AS SMALLINT) AS elev,
  CAST(((o_orderkey DIV 100) * 3 + (o_orderkey % 100) * 5) % 46 AS SMALLINT) AS slpd,
  CAST((o_custkey * 17) % 361 - 1 AS SMALLINT) AS asp,
  CAST({_fuel_code('(o_custkey % 43)')} AS SMALLINT) AS fbfm40,
  CAST(CASE WHEN o_orderkey % 71 = 3 THEN NULL ELSE (o_orderkey * 31) % 101 END AS SMALLINT) AS cc,
  CAST((o_orderkey * 7) % 400 AS SMALLINT) AS ch,
  CAST((o_orderkey * 3) % 100 AS SMALLINT) AS cbh,
  CAST((o_orderkey * 5) % 45 AS SMALLINT) AS cbd,
  CAST(CASE WHEN o_custkey % 5 = 0 THEN 7050 ELSE 7011 END AS SMALLINT) AS evt,
  CASE WHEN o_orderkey % 97 = 5 THEN NULL
       ELSE CAST((o_orderkey * 37) % 600 AS DOUBLE) / 100 END AS flamelength,
  CASE WHEN o_orderkey % 89 = 7 THEN NULL
       ELSE CAST((o_orderkey * 11 + o_custkey) % 5 AS DOUBLE) END AS crownstate,
  CAST((o_orderkey * 7919) % 40000 AS DOUBLE) AS heatarea,
  CASE WHEN o_orderkey % 83 = 9 THEN NULL
       ELSE CAST((o_orderkey * 13 + o_custkey) % 101 AS DOUBLE) / 100 END AS bp,
  CASE WHEN o_orderkey % 79 = 4 THEN NULL
       ELSE CAST((o_orderkey * 29 + o_custkey) % 97 AS DOUBLE) / 100 END AS bp_tr,
  CAST(o_totalprice AS DOUBLE) AS price,
  CAST((o_orderkey * 23 + o_custkey) % 900 AS INT) AS sdi,
  CAST((o_orderkey * 19 + o_custkey) % 800 AS INT) AS sdi_tr,
  o_orderkey AS pix, o_custkey AS seed
FROM {{orders}}"""

TYPES = ("Mech Thin", "Hand/Pile", "Rx Fire")

# Simulated fire behaviour, untreated and under each treatment type, at two percentiles.
VIEWS["fire_bl"] = Branches("px", tuple(
    (None, {
        "percentile": f"'{pct}'", "row": "row", "col": "col",
        "flamelength": f"CASE WHEN pix % 97 = 5 THEN NULL ELSE CAST((pix * {m} + seed) % 600 AS DOUBLE) / 100 END",
        "crownstate": f"CASE WHEN pix % 89 = 7 THEN NULL ELSE CAST((pix * {m} + seed) % 4 AS DOUBLE) END",
        "heatarea": f"CAST((pix * {m} * 7919) % 40000 AS DOUBLE)",
    })
    for pct, m in (("Pct50", 37), ("Pct90", 53))
))
VIEWS["fire_tr"] = Branches("px", tuple(
    (None, {
        "type": f"'{t}'", "percentile": f"'{pct}'", "row": "row", "col": "col",
        "flamelength": f"CASE WHEN pix % 91 = {k} THEN NULL ELSE CAST((pix * {m + k} + seed) % 450 AS DOUBLE) / 100 END",
        "crownstate": f"CASE WHEN pix % 73 = {k} THEN NULL ELSE CAST((pix * {m} + seed + {k}) % 3 AS DOUBLE) END",
        "heatarea": f"CAST((pix * {m + k} * 7919) % 30000 AS DOUBLE)",
    })
    for k, t in enumerate(TYPES)
    for pct, m in (("Pct50", 41), ("Pct90", 59))
))
VIEWS["bp_tr"] = Branches("px", tuple(
    (None, {
        "type": f"'{t}'", "row": "row", "col": "col",
        "bp": f"CASE WHEN pix % 79 = {k} THEN NULL ELSE CAST((pix * {29 + k} + seed) % 97 AS DOUBLE) / 100 END",
    })
    for k, t in enumerate(TYPES)
))
VIEWS["sdi_tr"] = Branches("px", tuple(
    (None, {
        "type": f"'{t}'", "row": "row", "col": "col",
        "sdi": f"CAST((pix * {19 + k} + seed) % 800 AS INT)",
    })
    for k, t in enumerate(TYPES)
))

# Treatment polygons: one per supplier, with overlaps; some have a hole or a second part, some
# are smaller than a cell, some lie off the grid. Columns g* are grid units, y grows upward.
_BASE = (
    "SELECT s_suppkey AS s, CAST((s_suppkey * 37) % 85 AS DOUBLE) + 0.25 AS u, "
    "CAST((s_suppkey * 3) DIV 2 AS DOUBLE) + 0.25 AS w FROM {supplier}"
)
_SHAPES = (
    # condition, id offset, part, ring, corners (right, down) relative to (u, w)
    ("true", 0, 0, 0, (("0", "0"), ("4 + s % 7", "s % 3"), ("3 + s % 9", "5 + s % 5"),
                       ("s % 2", "4 + s % 4"))),
    ("s % 7 = 0", 0, 0, 1, (("1.5", "1.5"), ("2.5", "1.5"), ("2.5", "2.5"), ("1.5", "2.5"))),
    ("s % 11 = 0", 0, 1, 0, (("10", "1"), ("13", "2"), ("11", "4"))),
    ("s % 25 = 0", 1000000, 0, 0, (("0", "0"), ("0.125", "0"), ("0.0625", "0.125"))),
    ("s % 50 = 0", 2000000, 0, 0, (("-200", "0"), ("-190", "0"), ("-195", "8"))),
)
VIEWS["zone_base"] = _BASE


def _shape_edges():
    for cond, offset, part, ring, corners in _SHAPES:
        for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1], strict=True)):
            yield cond, {
                "feature_id": f"s + {offset}", "part": str(part), "ring": str(ring), "seq": str(i),
                "x1": f"CAST((u + {a[0]}) * 30 AS DOUBLE)", "y1": f"CAST(-(w + {a[1]}) * 30 AS DOUBLE)",
                "x2": f"CAST((u + {b[0]}) * 30 AS DOUBLE)", "y2": f"CAST(-(w + {b[1]}) * 30 AS DOUBLE)",
            }


VIEWS["zone_edges"] = Branches("zone_base", tuple(_shape_edges()))
VIEWS["zone_attr"] = f"""
SELECT feature_id, feature_id AS ord,
  CASE s_nationkey % 3 WHEN 0 THEN '{TYPES[0]}' WHEN 1 THEN '{TYPES[1]}' ELSE '{TYPES[2]}' END AS type,
  CAST(feature_id % 50 AS DOUBLE) * 1.5 AS acres_gis
FROM (SELECT DISTINCT feature_id, feature_id % 1000000 AS s FROM {{zone_edges}}) z
JOIN {{supplier}} ON s_suppkey = s"""

# Regions: bands of the landscape, 25 columns by 40 rows each, as polygons.
VIEWS["region_base"] = (
    "SELECT DISTINCT CAST((o_orderkey % 100) DIV 25 AS INT) AS rc, "
    "CAST((o_orderkey DIV 100) DIV 40 AS INT) AS rr FROM {orders}"
)
VIEWS["region_edges"] = Branches("region_base", tuple(
    (None, {
        "region_id": "rr * 4 + rc", "part": "0", "ring": "0", "seq": str(i),
        "x1": f"CAST((rc * 25 + {x1}) * 30 AS DOUBLE)", "y1": f"CAST(-(rr * 40 + {y1}) * 30 AS DOUBLE)",
        "x2": f"CAST((rc * 25 + {x2}) * 30 AS DOUBLE)", "y2": f"CAST(-(rr * 40 + {y2}) * 30 AS DOUBLE)",
    })
    for i, (x1, y1, x2, y2) in enumerate(
        ((0, 0, 25, 0), (25, 0, 25, 40), (25, 40, 0, 40), (0, 40, 0, 0))
    )
))

# Roads: one segment per customer in the left part of the grid; trails: one per part.
VIEWS["roads"] = """
SELECT c_custkey AS feature_id, CAST(c_nationkey % 9 + 1 AS INT) AS highway_code,
  (CAST((c_custkey * 53) % 20 AS DOUBLE) + 0.3125) * 30 AS x1,
  -(CAST(c_custkey DIV 10 AS DOUBLE) + 0.34375) * 30 AS y1,
  (CAST((c_custkey * 53) % 20 + c_custkey % 5 AS DOUBLE) + 1.8125) * 30 AS x2,
  -(CAST(c_custkey DIV 10 + c_custkey % 3 AS DOUBLE) + 0.59375) * 30 AS y2
FROM {customer}"""
VIEWS["trails"] = """
SELECT p_partkey + 1000000 AS feature_id,
  (CAST(30 + (p_partkey * 31) % 15 AS DOUBLE) + 0.28125) * 30 AS x1,
  -(CAST(p_partkey DIV 13 AS DOUBLE) + 0.15625) * 30 AS y1,
  (CAST(30 + (p_partkey * 31) % 15 + p_partkey % 4 AS DOUBLE) + 0.65625) * 30 AS x2,
  -(CAST(p_partkey DIV 13 + p_partkey % 3 AS DOUBLE) + 0.84375) * 30 AS y2
FROM {part}"""
# Boundary lines: a three-segment polyline per supplier.
_POD_X = "(CAST((s_suppkey * 41) % 80 AS DOUBLE) + {0}) * 30"
_POD_Y = "-(CAST((s_suppkey * 3) DIV 2 AS DOUBLE) + {0}) * 30"
VIEWS["pod_lines"] = Branches("supplier", tuple(
    (None, {
        "feature_id": "s_suppkey", "seq": str(i), "x1": _POD_X.format(ax), "y1": _POD_Y.format(ay),
        "x2": _POD_X.format(bx), "y2": _POD_Y.format(by),
    })
    for i, (ax, ay, bx, by) in enumerate(
        ((0.3125, 0.40625, 4.8125, 1.65625), (4.8125, 1.65625, 6.3125, 5.15625),
         (6.3125, 5.15625, 12.5625, 6.40625))
    )
))

# Fires: points on the grid and as geographic positions.
VIEWS["fires"] = """
SELECT p_partkey AS fire_id, CAST(p_partkey % 8 AS STRING) AS pyrome_id,
  (CAST((p_partkey * 37) % 1000 AS DOUBLE) / 10 + 0.03) * 30 AS x,
  -(CAST(p_partkey * 7 AS DOUBLE) / 100 + 0.013) * 30 AS y,
  CAST(-112 AS DOUBLE) + CAST((p_partkey * 37) % 150 AS DOUBLE) / 20 + CAST(0.0213 AS DOUBLE)
    + CAST((p_partkey % 20) * 113 AS DOUBLE) / 100000 AS lon,
  CAST(36 AS DOUBLE) + CAST(p_partkey DIV 20 AS DOUBLE) / 20 + CAST(0.01317 AS DOUBLE) AS lat,
  CASE p_partkey % 3 WHEN 0 THEN DATE '2015-07-01' WHEN 1 THEN DATE '2017-07-01'
       ELSE DATE '2017-07-02' END AS ignition_date,
  CASE WHEN p_size <= 7 THEN 'A' WHEN p_size <= 14 THEN 'B' WHEN p_size <= 21 THEN 'C'
       WHEN p_size <= 28 THEN 'D' WHEN p_size <= 35 THEN 'E' WHEN p_size <= 42 THEN 'F'
       ELSE 'G' END AS size_class,
  CAST(p_size * p_size AS DOUBLE) / 4 AS size
FROM {part}"""
VIEWS["lattice"] = """
SELECT o_orderkey AS gid, CAST(248 AS DOUBLE) + CAST(o_orderkey % 150 AS DOUBLE) / 20 AS lon,
  CAST(36 AS DOUBLE) + CAST(o_orderkey DIV 150 AS DOUBLE) / 20 AS lat
FROM {orders}"""
VIEWS["wind_grid"] = Branches("lattice", tuple(
    (None, {
        "gid": "gid", "lon": "lon", "lat": "lat", "valid_date": f"DATE '{d}'", "utc_hour": str(h),
        "u": f"CAST((gid * {7 + h}) % 200 AS DOUBLE) / 10 - 10",
        "v": f"CAST((gid * {13 + k}) % 180 AS DOUBLE) / 10 - 9",
    })
    for k, d in enumerate(("2017-07-01", "2017-07-02"))
    for h in (19, 20)
))

# Daily weather of eight regions over seven years, with duplicates and gaps, raw and normalised.
VIEWS["wx_raw"] = """
SELECT CAST(l_suppkey % 8 AS STRING) AS pyrome, CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE 2 * l_quantity END AS erc,
  CAST(4 + l_linenumber AS DOUBLE) + CAST(l_partkey % 9 AS DOUBLE) / 8 AS fm100,
  CAST(8 + l_linenumber AS DOUBLE) AS fm1000,
  CAST(280 + l_partkey % 35 AS DOUBLE) AS tmmx, CAST(268 + l_partkey % 35 AS DOUBLE) AS tmmn,
  CAST(5 + l_orderkey % 60 AS DOUBLE) AS rmin, CAST(60 + l_orderkey % 40 AS DOUBLE) AS rmax,
  CAST((l_linenumber * l_partkey) % 30 AS DOUBLE) / 4 AS pr,
  CAST(1 + (l_orderkey * 3) % 12 AS DOUBLE) + 0.25 AS vs,
  CAST((l_partkey * 7) % 360 AS DOUBLE) AS th
FROM {lineitem}"""
VIEWS["wx"] = """
SELECT pyrome, date, CAST(year(date) AS INT) AS year, CAST(dayofyear(date) AS INT) AS doy, erc,
  fm100, fm1000, rmin, rmax, pr, tmmx * 9 / 5 - CAST(459.67 AS DOUBLE) AS tmmx_f,
  tmmn * 9 / 5 - CAST(459.67 AS DOUBLE) AS tmmn_f, vs * CAST(2.23694 AS DOUBLE) AS ws_mph,
  th AS wd_deg
FROM {wx_raw} WHERE erc IS NOT NULL"""
VIEWS["obs_uv"] = """
SELECT event_id, CAST(user_id % 8 AS STRING) AS pyrome_id, event_id AS fire_id,
  CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS utc_hour,
  CAST((event_id * 7) % 200 AS DOUBLE) / 10 - 10 AS u,
  CAST((event_id * 13) % 180 AS DOUBLE) / 10 - 9 AS v
FROM {events}"""
# Speeds in quarter mph and whole degrees, so that bin limits and calm are hit exactly.
VIEWS["obs"] = """
SELECT event_id, CAST(user_id % 8 AS STRING) AS pyrome_id, event_id AS fire_id, ts,
  CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS utc_hour,
  CAST((event_id * 7) % 140 AS DOUBLE) / 4 AS ws_mph,
  CAST((event_id * 13) % 361 AS DOUBLE) AS wd_deg
FROM {events}"""

# Weather scenarios and landscapes' value layers.
VIEWS["conditions"] = """
SELECT concat('pct', CAST(s_suppkey AS STRING)) AS Scenario, CAST(s_suppkey % 25 + 5 AS INT) AS WIND_SPEED,
  -1 AS WIND_DIRECTION, CAST(s_suppkey % 10 + 3 AS DOUBLE) AS FM_1hr,
  CAST(s_suppkey % 10 + 4 AS DOUBLE) AS FM_10hr, CAST(s_suppkey % 10 + 5 AS DOUBLE) AS FM_100hr,
  CAST(30 + s_suppkey % 25 AS DOUBLE) AS FM_herb, CAST(60 + s_suppkey % 25 AS DOUBLE) AS FM_woody,
  CASE WHEN s_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS GRIDDED_WINDS_GENERATE
FROM {supplier}"""
HVRAS = ("Total", "Water", "Timber")
VIEWS["nvc_bl"] = Branches("px", tuple(
    (None, {
        "hvra": f"'{'Composite' if h == 'Total' else h}'", "row": "row", "col": "col",
        "nvc": f"CASE WHEN pix % 67 = {k} THEN NULL ELSE CAST((pix * {5 + k} + seed) % 41 - 20 AS DOUBLE) END",
    })
    for k, h in enumerate(HVRAS)
))
VIEWS["nvc_tr"] = Branches("px", tuple(
    (None, {
        "hvra": f"'{h}'", "type": f"'{t}'", "row": "row", "col": "col",
        "nvc": f"CASE WHEN pix % 61 = {k} THEN NULL ELSE CAST((pix * {7 + k} + seed * {j + 1}) % 31 - 12 AS DOUBLE) END",
    })
    for k, h in enumerate(HVRAS)
    for j, t in enumerate(TYPES)
))
FEAS = ("hand", "mech", "rx", "mow")
VIEWS["feas"] = Branches("px", tuple(
    (None, {
        "scenario": f"'{s}'", "row": "row", "col": "col",
        "feas": f"CAST((pix + seed * {k + 1}) % 3 AS INT)",
    })
    for k, s in enumerate(FEAS)
))
VIEWS["masks"] = """
SELECT row, col, CAST(CASE WHEN seed % 9 = 0 THEN 0 ELSE 1 END AS INT) AS undisturbed,
  CAST(CASE WHEN fbfm40 < 100 THEN 0 ELSE 1 END AS INT) AS burnable,
  CAST(CASE WHEN pix % 53 = 0 THEN NULL WHEN pix % 13 = 0 THEN 0 ELSE 1 END AS INT) AS bps
FROM {px}"""

_GE = "(SELECT *, x1 / 30 AS ax, -y1 / 30 AS ay, x2 / 30 AS bx, -y2 / 30 AS b_y FROM {{{0}}})"


def cells_sql(edges: str, key: str = "feature_id") -> str:
    """Pixels whose centre lies inside a polygon, by the parity of the edges to their left."""
    return f"""
SELECT {key}, row, col FROM {{px}} JOIN {_GE.format(edges)}
  ON least(ay, b_y) <= row + 0.5::DOUBLE AND row + 0.5::DOUBLE < greatest(ay, b_y)
 AND ax + (row + 0.5::DOUBLE - ay) * (bx - ax) / (b_y - ay) <= col + 0.5::DOUBLE
GROUP BY {key}, row, col HAVING count(*) % 2 = 1"""


def border_sql(edges: str, key: str = "feature_id") -> str:
    """Pixels crossed by a segment: through the inside or through the top left corner they own."""
    return f"""
SELECT DISTINCT {key}, row, col FROM (
 SELECT *, greatest(0::DOUBLE,
        CASE WHEN bx = ax THEN 0 ELSE least((col - ax) / (bx - ax), (col + 1 - ax) / (bx - ax)) END,
        CASE WHEN b_y = ay THEN 0 ELSE least((row - ay) / (b_y - ay), (row + 1 - ay) / (b_y - ay)) END) AS lo,
   least(1::DOUBLE,
        CASE WHEN bx = ax THEN 1 ELSE greatest((col - ax) / (bx - ax), (col + 1 - ax) / (bx - ax)) END,
        CASE WHEN b_y = ay THEN 1 ELSE greatest((row - ay) / (b_y - ay), (row + 1 - ay) / (b_y - ay)) END) AS hi
 FROM {{px}} JOIN {_GE.format(edges)}
  ON floor(least(ay, b_y)) <= row AND row <= floor(greatest(ay, b_y))
 AND floor(least(ax, bx)) <= col AND col <= floor(greatest(ax, bx)))
WHERE lo < hi OR (lo = hi AND abs(ax + lo * (bx - ax) - col) < 1e-9 AND abs(ay + lo * (b_y - ay) - row) < 1e-9)"""


# Checker-only: cells of polygons and lines by brute force (every pixel against every edge).
CHECK_VIEWS = {
    "zone_cells": cells_sql("zone_edges"),
    "zone_border": border_sql("zone_edges"),
    "zone_touched": "SELECT * FROM {zone_cells} UNION SELECT * FROM {zone_border}",
    "zone_grid": "SELECT row, col, max(feature_id) AS feature_id FROM {zone_cells} GROUP BY row, col",
    "zone_grid_type": """
SELECT type, row, col, max(feature_id) AS feature_id FROM {zone_cells}
JOIN {zone_attr} USING (feature_id) GROUP BY type, row, col""",
    "region_cells": "SELECT (row // 40) * 4 + col // 25 AS region_id, row, col FROM {px}",
    "road_cells": border_sql("roads", "highway_code, feature_id"),
    "trail_cells": border_sql("trails"),
    "pod_cells": border_sql("pod_lines"),
}

_REF = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def duck(body: str, **extra: str) -> str:
    """A checking query: ``{view}`` references become CTEs in dependency order."""
    texts = {**VIEWS, **CHECK_VIEWS, **extra}
    texts = {n: v.union_sql() if isinstance(v, Branches) else v for n, v in texts.items()}
    order: list[str] = []

    def need(sql: str) -> None:
        for ref in _REF.findall(sql):
            if ref in texts and ref not in order:
                need(texts[ref])
                order.append(ref)

    need(body)
    name = lambda ref: f"v_{ref}" if ref in texts else ref
    sub = lambda sql: _REF.sub(lambda m: name(m.group(1)), sql)
    ctes = ",\n".join(f"{name(r)} AS MATERIALIZED ({sub(texts[r]).strip()})" for r in order)
    out = (f"WITH {ctes}\n" if ctes else "") + sub(body).strip()
    return re.sub(r"\bDIV\b", "//", out)


class Tables:
    """Attribute access to the derived tables of one directory, as Spark plans over its files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = table(self.spark, self.sf_dir, name)
        elif name in VIEWS:
            text = VIEWS[name]
            text = text.spark_sql() if isinstance(text, Branches) else text
            df = self.spark.sql(text, **{r: getattr(self, r) for r in set(_REF.findall(text))})
        else:
            raise AttributeError(name)
        self.__dict__[name] = df  # a plan, not data: resolved once per query
        return df

    @cached_property
    def grid(self) -> Grid:
        """Grid of the landscape; the row count comes from parquet metadata."""
        n = self.orders.count()
        return Grid(x0=0.0, y0=0.0, cell=CELL, nrows=(n + NCOLS - 1) // NCOLS, ncols=NCOLS)

"""Regridding between projections; the checking SQL solves the Albers latitude by iteration."""

from __future__ import annotations

from dataclasses import replace

from firegrid import Grid
from firegrid.functions import albers, utm
from firegrid.operators import algebra

from .registry import query, r6
from .views import CELL

# The landscape as a grid of UTM zone 12, and an Albers grid over it that is turned by some degrees.
SOURCE = Grid(x0=400_000.0, y0=4_200_000.0, cell=CELL, crs="EPSG:26912")
TARGET = Grid(x0=-1_398_090.0, y0=1_775_340.0, cell=CELL, crs="EPSG:5070")

_Q = f"(1 - {albers._E2!r}) * (sin(p) / (1 - {albers._E2!r} * sin(p) ** 2) - ln((1 - {albers._E!r} * sin(p)) / (1 + {albers._E!r} * sin(p))) / (2 * {albers._E!r}))"
_STEP = f"SELECT * REPLACE (p + (q - {_Q}) * (1 - {albers._E2!r} * sin(p) ** 2) ** 2 / (2 * (1 - {albers._E2!r}) * cos(p)) AS p) FROM "


def back_sql() -> str:
    """Target cells with their place in the source grid."""
    east, north = f"({TARGET.x0!r} + (col + 0.5) * 30)", f"({albers.RHO0!r} - ({TARGET.y0!r} - (row + 0.5) * 30))"
    start = f"""(SELECT row, col, degrees(atan2({east}, {north})) / {albers.CONE!r} + {albers.ORIGIN_LON!r} AS lon,
 ({albers.C_TERM!r} - (sqrt({east} ** 2 + {north} ** 2) * {albers.CONE!r} / {albers.SEMI_MAJOR!r}) ** 2) / {albers.CONE!r} AS q, 0.6::DOUBLE AS p FROM {{px}})"""
    solved = start
    for _ in range(8):
        solved = f"({_STEP}{solved})"
    s = "sin(p)"
    tangent = f"sinh(atanh({s}) - {utm.ECCENTRIC!r} * atanh({utm.ECCENTRIC!r} * {s}))"
    plane = f"(SELECT row, col, radians(lon + 111) AS l, {tangent} AS t FROM {solved})"
    turned = f"(SELECT row, col, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(1 + t * t)) AS eta FROM {plane})"
    up = " + ".join(["xi"] + [f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(utm.FORWARD, 1)])
    right = " + ".join(["eta"] + [f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(utm.FORWARD, 1)])
    unit = utm.SCALE * utm.RADIUS
    return f"""SELECT row, col, ({utm.FALSE_EAST!r} + {unit!r} * ({right}) - {SOURCE.x0!r}) / 30 AS gx, ({SOURCE.y0!r} - {unit!r} * ({up})) / 30 AS gy FROM {turned}"""


@query(
    "P13 P17 G29",
    "SELECT b.row, b.col, elev, fbfm40 FROM {back} b LEFT JOIN {px} p ON p.row = floor(gy) AND p.col = floor(gx)",
    back=back_sql(),
)
def regridded_nearest(t):
    source = replace(SOURCE, nrows=t.grid.nrows, ncols=t.grid.ncols)
    return algebra.regrid(t.px, source, t.px.select("row", "col"), TARGET, ["elev", "fbfm40"])


@query(
    "P13 P17 G29",
    """SELECT b.row, b.col, round(sum(w * flamelength) / nullif(sum(w) FILTER (WHERE flamelength IS NOT NULL), 0), 6) AS flamelength FROM (
 SELECT row, col, floor(gy - 0.5) + i AS r, floor(gx - 0.5) + j AS c, (1 - abs(gy - 0.5 - floor(gy - 0.5) - i)) * (1 - abs(gx - 0.5 - floor(gx - 0.5) - j)) AS w
 FROM {back}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) z(j)) b LEFT JOIN {px} p ON p.row = r AND p.col = c GROUP BY b.row, b.col""",
    back=back_sql(),
)
def regridded_bilinear(t):
    return r6(algebra.regrid(t.px, SOURCE, t.px.select("row", "col"), TARGET, ["flamelength"], bilinear=True))

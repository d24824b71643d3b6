"""Longitude/latitude ↔ EPSG:5070 metres (ellipsoidal Albers equal-area, Snyder 1987)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

# Public parameters of EPSG:5070 (GRS80 ellipsoid).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLELS = (29.5, 45.5)
ORIGIN_LAT, ORIGIN_LON = 23.0, -96.0

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q_float(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m2_float(lat: float) -> float:
    s, c = math.sin(math.radians(lat)), math.cos(math.radians(lat))
    return c * c / (1 - _E2 * s * s)


_Q1, _Q2 = (_q_float(p) for p in PARALLELS)
_M1, _M2 = (_m2_float(p) for p in PARALLELS)
CONE = (_M1 - _M2) / (_Q2 - _Q1)
C_TERM = _M1 + CONE * _Q1
RHO0 = SEMI_MAJOR * math.sqrt(C_TERM - CONE * _q_float(ORIGIN_LAT)) / CONE


def to_epsg5070(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Easting and northing of a geographic position."""
    s = F.sin(F.radians(col(lat)))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = SEMI_MAJOR * F.sqrt(C_TERM - CONE * q) / CONE
    theta = CONE * F.radians(col(lon) - ORIGIN_LON)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def from_epsg5070(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing, to fractions of a millimetre.

    The series for the latitude of equal area is followed by one step of Newton's method.
    """
    east, north = col(x), RHO0 - col(y)
    q = (C_TERM - (F.hypot(east, north) * CONE / SEMI_MAJOR) ** 2) / CONE
    beta = F.asin(q / _q_float(90.0))
    e4, e6 = _E2**2, _E2**3
    series = (
        (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 2), (23 * e4 / 360 + 251 * e6 / 3780, 4), (761 * e6 / 45360, 6)
    )
    phi = beta
    for factor, times in series:
        phi = phi + factor * F.sin(times * beta)
    s = F.sin(phi)
    rest = q / (1 - _E2) - s / (1 - _E2 * s * s) + F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E)
    phi = phi + (1 - _E2 * s * s) ** 2 / (2 * F.cos(phi)) * rest
    return F.degrees(F.atan2(east, north)) / CONE + ORIGIN_LON, F.degrees(phi)


def to_grid_crs(df: DataFrame, crs: str, grid_crs: str, pairs=(("x", "y"),)) -> DataFrame:
    """Project coordinate pairs to the grid's system; equal systems pass through unchanged."""
    if crs == grid_crs:
        return df
    if (crs, grid_crs) != ("EPSG:4326", "EPSG:5070"):
        raise ValueError(f"no transformation from {crs} to {grid_crs}")
    for x, y in pairs:
        east, north = to_epsg5070(x, y)
        df = df.withColumns({x: east, y: north})
    return df

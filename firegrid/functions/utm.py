"""Longitude/latitude ↔ UTM metres (transverse Mercator by Krüger's series to the fourth order)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import albers
from .common import col

# The projection's scale and false origin, and the series of the third flattening.
SCALE, FALSE_EAST = 0.9996, 500_000.0
_N = albers.FLATTENING / (2 - albers.FLATTENING)
RADIUS = albers.SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BACKWARD = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
ECCENTRIC = 2 * math.sqrt(_N) / (1 + _N)


def zone_of(crs: str) -> int | None:
    """Zone of a northern UTM system (NAD83 or WGS84), else None."""
    found = re.fullmatch(r"EPSG:(?:269|326)(\d\d)", crs)
    return int(found[1]) if found and 1 <= int(found[1]) <= 60 else None


def to_utm(lon: Column | str, lat: Column | str, zone: int) -> tuple[Column, Column]:
    """Easting and northing in a northern zone."""
    away = F.radians(col(lon) - (6 * zone - 183))
    s = F.sin(F.radians(col(lat)))
    t = F.sinh(F.atanh(s) - ECCENTRIC * F.atanh(ECCENTRIC * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(FORWARD, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return FALSE_EAST + SCALE * RADIUS * east, SCALE * RADIUS * north


def from_utm(x: Column | str, y: Column | str, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing in a northern zone."""
    north, east = col(y) / (SCALE * RADIUS), (col(x) - FALSE_EAST) / (SCALE * RADIUS)
    xi, eta = north, east
    for j, b in enumerate(BACKWARD, 1):
        xi = xi - b * F.sin(2 * j * north) * F.cosh(2 * j * east)
        eta = eta - b * F.cos(2 * j * north) * F.sinh(2 * j * east)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(LATITUDE, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(phi)


def transformed(x: Column | str, y: Column | str, crs: str, to: str) -> tuple[Column, Column]:
    """A position in another system: EPSG:4326, EPSG:5070 or a northern UTM zone; the datums count as one."""
    if crs == to:
        return col(x), col(y)
    if crs == "EPSG:4326":
        lon, lat = col(x), col(y)
    elif crs == "EPSG:5070":
        lon, lat = albers.from_epsg5070(x, y)
    elif zone_of(crs):
        lon, lat = from_utm(x, y, zone_of(crs))
    else:
        raise ValueError(f"no transformation from {crs}")
    if to == "EPSG:4326":
        return lon, lat
    if to == "EPSG:5070":
        return albers.to_epsg5070(lon, lat)
    if zone_of(to):
        return to_utm(lon, lat, zone_of(to))
    raise ValueError(f"no transformation to {to}")

"""Imports every query module, so that the registry is complete."""

from . import overlay_queries, pixel_queries, regrid_queries, report_queries, scalar_queries, source_queries, spatial_queries, weather_queries, zonal_queries  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]

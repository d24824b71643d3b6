"""Fuel-moisture and growing-season equations (Cohen & Deeming 1985, Tetens 1930,
Spencer 1971, Jolly et al. 2005) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import clip, col


def kelvin_to_fahrenheit(kelvin: Column | str) -> Column:
    return col(kelvin) * 9.0 / 5.0 - 459.67


def calc_emc(temp_f: Column | str, rh_pct: Column | str) -> Column:
    """Equilibrium moisture content in percent, three humidity regimes, never below zero."""
    t, h = col(temp_f), col(rh_pct)
    dry = 0.03229 + 0.281073 * h - 0.000578 * t * h
    mid = 2.22749 + 0.160107 * h - 0.014784 * t
    wet = 21.0606 + 0.005565 * h * h - 0.00035 * t * h - 0.483199 * h
    return clip(F.when(h < 10.0, dry).when(h < 50.0, mid).when(h >= 50.0, wet), low=0.0)


# Moisture of 1-h and 10-h fuels relative to the equilibrium.
FM_1HR_FACTOR = 1.03
FM_10HR_FACTOR = 1.28


def calc_1hr_fm(temp_f: Column | str, rh_pct: Column | str) -> Column:
    return FM_1HR_FACTOR * calc_emc(temp_f, rh_pct)


def calc_10hr_fm(temp_f: Column | str, rh_pct: Column | str) -> Column:
    return FM_10HR_FACTOR * calc_emc(temp_f, rh_pct)


def calc_vpd_pa(temp_f: Column | str, rh_pct: Column | str) -> Column:
    """Vapour pressure deficit in pascal from temperature (°F) and relative humidity (%)."""
    celsius = (col(temp_f) - 32.0) * 5.0 / 9.0
    saturation = 610.78 * F.exp(17.2694 * celsius / (celsius + 237.3))
    return clip(saturation - saturation * (col(rh_pct) / 100.0), low=0.0)


def calc_daylength(doy: Column | str, lat_deg: Column | str | float) -> Column:
    """Hours of daylight for a day of year and a latitude."""
    lat = F.lit(float(lat_deg)) if isinstance(lat_deg, (int, float)) else col(lat_deg)
    b = 2.0 * math.pi * (col(doy) - 1) / 365.0
    declination = (
        0.006918
        - 0.399912 * F.cos(b)
        + 0.070257 * F.sin(b)
        - 0.006758 * F.cos(2 * b)
        + 0.000907 * F.sin(2 * b)
        - 0.002697 * F.cos(3 * b)
        + 0.00148 * F.sin(3 * b)
    )
    hour_angle = F.acos(clip(-F.tan(F.radians(lat)) * F.tan(declination), -1.0, 1.0))
    return 2.0 * F.degrees(hour_angle) / 15.0


def _ramp(value: Column, zero_at: float, one_at: float) -> Column:
    """Linear 0→1 between two thresholds, clipped; a falling ramp has ``zero_at > one_at``."""
    return clip((value - zero_at) / (one_at - zero_at), 0.0, 1.0)


def calc_gsi(tmin_f: Column | str, vpd_pa: Column | str, daylength_hr: Column | str) -> Column:
    """Growing Season Index in [0, 1]: minimum temperature x dryness x photoperiod."""
    return (
        _ramp(col(tmin_f), 28.4, 41.0)
        * _ramp(col(vpd_pa), 4100.0, 900.0)
        * _ramp(col(daylength_hr), 10.0, 11.0)
    )


def calc_herb_fm(
    doy: Column | str,
    dormant_fm: float = 30.0,
    green_fm: float = 250.0,
    green_start_doy: int = 91,
    dormant_start_doy: int = 250,
) -> Column:
    """Live herbaceous moisture by day of year; before green-up the green value is returned."""
    cured = _ramp(col(doy), float(green_start_doy), float(dormant_start_doy))
    return clip(green_fm + cured * (dormant_fm - green_fm), 30.0, 250.0)


def calc_woody_fm(
    doy: Column | str,
    peak_fm: float = 200.0,
    min_fm: float = 60.0,
    peak_doy: int = 152,
    trough_doy: int = 274,
) -> Column:
    """Live woody moisture by day of year (cosine between peak and trough)."""
    angle = math.pi * (col(doy) - peak_doy) / float(trough_doy - peak_doy)
    return clip((peak_fm + min_fm) / 2.0 + (peak_fm - min_fm) / 2.0 * F.cos(angle), 50.0, 200.0)


def calc_herb_fm_gsi(
    gsi: Column | str, dormant_fm: float = 30.0, green_fm: float = 250.0
) -> Column:
    return clip(dormant_fm + _ramp(col(gsi), 0.5, 1.0) * (green_fm - dormant_fm), 30.0, 250.0)


def calc_woody_fm_gsi(
    gsi: Column | str, dormant_fm: float = 60.0, green_fm: float = 200.0
) -> Column:
    return clip(dormant_fm + _ramp(col(gsi), 0.5, 1.0) * (green_fm - dormant_fm), 50.0, 200.0)

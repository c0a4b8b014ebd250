"""Sun times of a place and day as column math, after the public SunCalc formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000
_J1970, _J2000 = 2440588.0, 2451545.0
_RAD = math.pi / 180
_OBLIQUITY = 23.4397 * _RAD
_PERIHELION = 102.9372 * _RAD
_TRANSIT = 0.0009

SUNRISE_ANGLE = -0.833
NAUTICAL_ANGLE = -12.0


def sun_times(at_us: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """Days since J2000 of sunrise, sunset, nautical dawn and dusk, plus ``now`` for the instant.

    ``at_us`` is the instant in UTC microseconds. Where the sun never reaches
    an angle that day, its two times are NaN.
    """
    now = at_us / F.lit(_DAY_US) - 0.5 + _J1970 - _J2000
    west, phi = -lon * _RAD, lat * _RAD
    cycle = F.round(now - _TRANSIT - west / (2 * math.pi))

    def approximate(hour_angle: Column) -> Column:
        return F.lit(_TRANSIT) + (hour_angle + west) / (2 * math.pi) + cycle

    noon_guess = approximate(F.lit(0.0))
    anomaly = (F.lit(357.5291) + noon_guess * 0.98560028) * _RAD
    center = (
        F.sin(anomaly) * 1.9148 + F.sin(anomaly * 2) * 0.02 + F.sin(anomaly * 3) * 0.0003
    ) * _RAD
    longitude = anomaly + center + _PERIHELION + math.pi
    declination = F.asin(F.sin(longitude) * math.sin(_OBLIQUITY))
    equation = F.sin(anomaly) * 0.0053 - F.sin(longitude * 2) * 0.0069
    noon = noon_guess + equation

    def crossing(degrees: float) -> tuple[Column, Column]:
        cosine = (math.sin(degrees * _RAD) - F.sin(phi) * F.sin(declination)) / (
            F.cos(phi) * F.cos(declination)
        )
        evening = approximate(F.acos(cosine)) + equation
        return noon * 2 - evening, evening

    sunrise, sunset = crossing(SUNRISE_ANGLE)
    dawn, dusk = crossing(NAUTICAL_ANGLE)
    return {"now": now, "sunrise": sunrise, "sunset": sunset, "dawn": dawn, "dusk": dusk}


def twilight(at_us: Column, lat: Column, lon: Column) -> Column:
    """``dawn``, ``dusk`` or NULL; both bounds are strict, and a missing crossing is no twilight."""
    t = sun_times(at_us, lat, lon)

    def between(start: Column, end: Column) -> Column:
        return ~F.isnan(start) & ~F.isnan(end) & (t["now"] > start) & (t["now"] < end)

    return F.when(between(t["sunset"], t["dusk"]), F.lit("dusk")).when(
        between(t["dawn"], t["sunrise"]), F.lit("dawn")
    )

"""The sun's apparent position by the NOAA equations, as Column expressions on UTC timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: NOAA's coefficients of cos and sin of the fractional year and its multiples.
EQUATION_OF_TIME = (229.18, 0.000075, (0.001868, -0.014615), (-0.032077, -0.040849))
DECLINATION = (1.0, 0.006918, (-0.399912, -0.006758, -0.002697), (0.070257, 0.000907, 0.00148))
SUNRISE_ZENITH = 90.833


def series(gamma: Column, terms) -> Column:
    factor, constant, cosines, sines = terms
    out = F.lit(constant)
    for k, (c, s) in enumerate(zip(cosines, sines), 1):
        out = out + c * F.cos(k * gamma) + s * F.sin(k * gamma)
    return factor * out


def fractional_year(utc: Column) -> Column:
    year = F.year(utc)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    hour = F.hour(utc) + F.minute(utc) / 60 + F.floor(F.second(utc)) / 3600
    return F.lit(2 * math.pi) / F.when(leap, 366).otherwise(365) * (F.dayofyear(utc) - 1 + (hour - 12) / 24)


#: Refraction in seconds of arc. Above 5 degrees by the tangent, its third and fifth power; above the
#: horizon by powers of the elevation from 0 on; below it by the tangent.
HIGH, LOW, BELOW = (58.1, -0.07, 0.000086), (1735, -518.2, 103.4, -12.79, 0.711), -20.772


def refraction(elevation: Column) -> Column:
    tan = F.tan(F.radians(elevation))
    polynomial = F.lit(LOW[-1])
    for c in LOW[-2::-1]:
        polynomial = c + elevation * polynomial
    high = HIGH[0] / tan + HIGH[1] / F.pow(tan, F.lit(3)) + HIGH[2] / F.pow(tan, F.lit(5))
    return F.when(elevation > 85, 0.0).when(elevation > 5, high / 3600).when(elevation > -0.575, polynomial / 3600).otherwise(BELOW / tan / 3600)


def position(utc: Column, lat: float, lon: float) -> tuple[Column, Column, Column]:
    """(elevation with refraction, azimuth clockwise from north, zenith) in degrees; true time has no seconds."""
    gamma = fractional_year(utc)
    decl = series(gamma, DECLINATION)
    minutes = F.hour(utc) * 60 + F.minute(utc) + series(gamma, EQUATION_OF_TIME) + 4 * lon
    angle = F.radians(F.pmod(minutes, F.lit(1440.0)) / 4 - 180)
    sin_lat, cos_lat = math.sin(math.radians(lat)), math.cos(math.radians(lat))
    up = sin_lat * F.sin(decl) + cos_lat * F.cos(decl) * F.cos(angle)
    zenith = F.degrees(F.acos(F.least(F.greatest(up, F.lit(-1.0)), F.lit(1.0))))
    east = -F.cos(decl) * F.sin(angle)
    north = cos_lat * F.sin(decl) - sin_lat * F.cos(decl) * F.cos(angle)
    elevation = 90 - zenith
    return elevation + refraction(elevation), F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), zenith


def sunrise_sunset(day: Column, lat: float, lon: float) -> tuple[Column, Column]:
    """Minutes after UTC midnight of the sun's rise and set; null where it does neither."""
    noon = F.date_trunc("day", day) + F.expr("interval 12 hours")
    gamma = fractional_year(noon)
    decl, eq = series(gamma, DECLINATION), series(gamma, EQUATION_OF_TIME)
    phi = math.radians(lat)
    cos_h = math.cos(math.radians(SUNRISE_ZENITH)) / (math.cos(phi) * F.cos(decl)) - math.tan(phi) * F.tan(decl)
    half = F.when(cos_h.between(-1, 1), F.degrees(F.acos(cos_h)))
    return 720 - 4 * (lon + half) - eq, 720 - 4 * (lon - half) - eq


def sql_series(gamma: str, terms) -> str:
    factor, constant, cosines, sines = terms
    body = " ".join(f"+ CAST({c} AS DOUBLE) * cos({k} * {gamma}) + CAST({s} AS DOUBLE) * sin({k} * {gamma})" for k, (c, s) in enumerate(zip(cosines, sines), 1))
    return f"(CAST({factor} AS DOUBLE) * (CAST({constant} AS DOUBLE) {body}))"

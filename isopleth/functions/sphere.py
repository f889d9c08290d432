"""Scalar expressions on the sphere and in the reference atmosphere, and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as const

EARTH_KM = 6371.0088


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km of points in degrees."""
    lon1, lat1, lon2, lat2 = (F.radians(x) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def meridional_coordinate(lat: Column) -> Column:
    """Distance from the equator in km."""
    return F.radians(lat) * EARTH_KM


def cosine_latitude(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def coriolis(lat: Column) -> Column:
    return F.sin(F.radians(lat)) * (2 * const.Omega)


def beta(lat: Column) -> Column:
    return F.abs(F.cos(F.radians(lat)) * (2 * const.Omega)) / const.a


def reference_height(pressure_hpa: Column) -> Column:
    """Height in km of a pressure at a constant scale height."""
    return F.log(F.lit(const.p0 / 100) / pressure_hpa) * (const.H / 1000)


def reference_density(pressure_hpa: Column) -> Column:
    """kg m-3 at 300 K."""
    return pressure_hpa * (100 / (const.Rd * 300))


def reference_potential_temperature(pressure_hpa: Column) -> Column:
    """K, of air at 300 K."""
    return F.pow(F.lit(const.p0 / 100) / pressure_hpa, F.lit(const.kappa)) * 300


def calendar(time: Column) -> dict[str, Column]:
    """The parts of a time: year, month, day, hour, minute, second."""
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    return {k: f(time).cast("int") for k, f in parts.items()}


def season(time: Column) -> Column:
    m = F.month(time)
    return F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")

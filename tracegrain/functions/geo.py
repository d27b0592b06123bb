"""Geometry as Column expressions: they stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
MERCATOR_RADIUS_M = 6_378_137.0


def _haversine_a(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.when(a > 1, F.lit(1.0)).otherwise(a)  # least() would turn a missing neighbour into 1


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees (arctangent form)."""
    a = _haversine_a(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_arcsin_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between points in degrees (arcsine form)."""
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(_haversine_a(lat1, lon1, lat2, lon2)))


def bearing_rad(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in radians, from -pi to pi."""
    a, b, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    x = F.sin(dlon) * F.cos(b)
    y = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return F.atan2(x, y)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, from 0 below 360."""
    return F.pmod(F.degrees(bearing_rad(lat1, lon1, lat2, lon2)) + 360.0, F.lit(360.0))


def turn_deg(first: Column, second: Column) -> Column:
    """Angle between two bearings in radians, as degrees from 0 to 180."""
    d = F.abs(second - first)
    return F.degrees(F.when(d > np.pi, 2 * np.pi - d).otherwise(d))


def planar_angle_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat3: Column, lon3: Column) -> Column:
    """Interior angle at the second point in plain degrees: straight on is 180; 0 if two points coincide."""
    ax, ay, bx, by = lat1 - lat2, lon1 - lon2, lat3 - lat2, lon3 - lon2
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.least(F.try_divide(ax * bx + ay * by, na * nb), F.lit(1.0)), F.lit(-1.0))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def planar_radians_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by plain Euclid on (lat, lon) in radians: no shrinking of longitudes."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    return F.lit(EARTH_RADIUS_M) * F.sqrt(dlat * dlat + dlon * dlon)


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS_M)


def mercator_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS_M)) - F.lit(np.pi / 2))


def point_within(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies strictly inside a closed ring of ``struct<lon, lat>``: edges are outside.

    Even-odd rule by folding over the ring's edges; a point on an edge is
    excluded separately, since the rule alone counts some edges as inside.
    """
    edges = F.sequence(F.lit(0), F.size(ring) - 2)

    def corner(i: Column) -> tuple[Column, Column, Column, Column]:
        a, b = ring[i], ring[i + 1]
        return a["lon"], a["lat"], b["lon"], b["lat"]

    def crosses(i: Column) -> Column:
        x1, y1, x2, y2 = corner(i)
        at = x1 + (lat - y1) * F.try_divide(x2 - x1, y2 - y1)
        return F.when(((y1 > lat) != (y2 > lat)) & (lon < at), 1).otherwise(0)

    def touches(i: Column) -> Column:
        x1, y1, x2, y2 = corner(i)
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        return (cross == 0) & lon.between(F.least(x1, x2), F.greatest(x1, x2)) & lat.between(F.least(y1, y2), F.greatest(y1, y2))

    odd = F.aggregate(edges, F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1
    return odd & ~F.exists(edges, touches)


def _vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, f = 6_378_137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    length = np.radians(lon2 - lon1)
    lam = length.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            s = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
            sigma = np.arctan2(s, c)
            sa = np.where(s == 0, 0.0, np.cos(u1) * np.cos(u2) * sl / s)
            ca2 = 1 - sa * sa
            cm = np.where(ca2 == 0, 0.0, c - 2 * np.sin(u1) * np.sin(u2) / ca2)
            k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            before, lam = lam, length + (1 - k) * f * sa * (sigma + k * s * (cm + k * c * (2 * cm * cm - 1)))
            if np.nanmax(np.abs(lam - before), initial=0.0) < 1e-12:
                break
        u = ca2 * (a * a - b * b) / (b * b)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = big_b * s * (cm + big_b / 4 * (c * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    return np.where(s == 0, 0.0, b * big_a * (sigma - d))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the WGS-84 ellipsoid (Vincenty's inverse formula, in Arrow batches).

    Spark has no such function; where 0.5 % suffices, :func:`haversine_m` stays
    in generated code. Null if any coordinate is null.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
            out = _vincenty(*values)
            out[np.isnan(values).any(axis=0)] = np.nan
            yield pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return run(lat1, lon1, lat2, lon2)

"""WGS-84 geodesy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the WGS-84 ellipsoid, and metres of a nautical mile.
A = 6378137.0
INV_F = 298.257223563
FLAT = 1 / INV_F
E2 = FLAT * (2 - FLAT)
NM = 1852.0


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of degrees and metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - E2) + alt) * F.sin(la)


def lla_to_ned(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """North, east and down metres about a reference."""
    x, y, z = (a - b for a, b in zip(ecef(lat, lon, alt), ecef(lat0, lon0, alt0)))
    la, lo = F.radians(lat0), F.radians(lon0)
    n = -F.sin(la) * F.cos(lo) * x - F.sin(la) * F.sin(lo) * y + F.cos(la) * z
    e = -F.sin(lo) * x + F.cos(lo) * y
    d = -F.cos(la) * F.cos(lo) * x - F.cos(la) * F.sin(lo) * y - F.sin(la) * z
    return n, e, d


def ned_to_ecef(n: Column, e: Column, d: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    la, lo = F.radians(lat0), F.radians(lon0)
    x0, y0, z0 = ecef(lat0, lon0, alt0)
    x = -F.sin(la) * F.cos(lo) * n - F.sin(lo) * e - F.cos(la) * F.cos(lo) * d
    y = -F.sin(la) * F.sin(lo) * n + F.cos(lo) * e - F.cos(la) * F.sin(lo) * d
    z = F.cos(la) * n - F.sin(la) * d
    return x0 + x, y0 + y, z0 + z


def latitude_step(z: Column, p: Column, lat: Column) -> Column:
    """One step of the fixed-point iteration for the geodetic latitude (radians); p is the distance from the axis."""
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.atan2(z + E2 * n * F.sin(lat), p)


def flat_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Local flat earth: x east and y north metres, a minute of arc being a nautical mile."""
    return (lon - lon0) * 60.0 * NM * F.cos(F.radians(lat0)), (lat - lat0) * 60.0 * NM


def flat_lonlat(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return x / (60.0 * NM * F.cos(F.radians(lat0))) + lon0, y / (60.0 * NM) + lat0

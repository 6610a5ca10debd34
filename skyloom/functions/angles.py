"""Angles: wrapping, degrees and sexagesimal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_360(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def wrap_180(deg: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def wrap_90(deg: Column) -> Column:
    """Axis direction, to [-90, 90)."""
    return F.pmod(deg + 90.0, F.lit(180.0)) - 90.0


def dms_to_decimal(d: Column, m: Column, s: Column, sign: Column) -> Column:
    """Degrees, minutes and seconds; S and W are negative."""
    return (d + m / 60.0 + s / 3600.0) * F.when(sign.isin("S", "W", "s", "w"), -1.0).otherwise(1.0)


def decimal_to_dms(x: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, whole minutes and seconds of the absolute value."""
    a = F.abs(x)
    d = F.floor(a)
    m = F.floor((a - d) * 60.0)
    return d, m, ((a - d) * 60.0 - m) * 60.0


def course(dn: Column, de: Column) -> Column:
    """Direction of a displacement, 0 to 360 degrees."""
    return wrap_360(F.degrees(F.atan2(de, dn)))

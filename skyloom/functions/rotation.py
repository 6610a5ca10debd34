"""Quaternions (scalar first) and yaw-pitch-roll angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def from_ypr(yaw: Column, pitch: Column, roll: Column) -> Quat:
    """Rotation by yaw, then pitch, then roll, in degrees."""
    cy, sy, cp, sp, cr, sr = (f(F.radians(a) / 2) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    return (
        cr * cp * cy + sr * sp * sy,
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
    )


def product(a: Quat, b: Quat) -> Quat:
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def inverse(q: Quat) -> Quat:
    n = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    return q[0] / n, -q[1] / n, -q[2] / n, -q[3] / n


def matrix(q: Quat) -> list[list[Column]]:
    """Body to world, rows first."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def to_ypr(q: Quat) -> tuple[Column, Column, Column]:
    """Yaw, pitch and roll in degrees; the sine of the pitch is held within -1 and 1."""
    w, x, y, z = q
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - x * z)))
    return (
        F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))),
        F.degrees(F.asin(s)),
        F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))),
    )


def apply(m: list[list[Column]], v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)

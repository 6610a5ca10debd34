"""Pin-hole camera with radial and tangential distortion, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rotation


@dataclass(frozen=True)
class Camera:
    """Focal lengths and centre in pixels; distortion k1, k2, p1, p2, k3."""

    fx: float
    fy: float
    cu: float
    cv: float
    dist: tuple[float, float, float, float, float] = (0.0, 0.0, 0.0, 0.0, 0.0)

    def normal(self, u: Column, v: Column) -> tuple[Column, Column]:
        return (u - self.cu) / self.fx, (v - self.cv) / self.fy

    def pixel(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x * self.fx + self.cu, y * self.fy + self.cv

    def distortion(self, x: Column, y: Column) -> tuple[Column, Column, Column]:
        """Radial factor and tangential shifts at a normal point."""
        k1, k2, p1, p2, k3 = self.dist
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
        return radial, 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y

    def distort(self, u: Column, v: Column) -> tuple[Column, Column]:
        """Pixel of an ideal camera -> pixel of this one."""
        x, y = self.normal(u, v)
        f, dx, dy = self.distortion(x, y)
        return self.pixel(x * f + dx, y * f + dy)

    def undistort_step(self, x0: Column, y0: Column, x: Column, y: Column) -> tuple[Column, Column]:
        """One fixed-point step to the ideal normal point of the distorted (x0, y0)."""
        f, dx, dy = self.distortion(x, y)
        return (x0 - dx) / f, (y0 - dy) / f

    def ray(self, u: Column, v: Column, q: rotation.Quat) -> tuple[Column, ...]:
        """Unit north-east-down ray of a pixel; the camera looks along the body's first axis."""
        x, y = self.normal(u, v)
        n, e, d = rotation.apply(rotation.matrix(q), (F.lit(1.0), x, y))
        size = F.sqrt(n * n + e * e + d * d)
        return n / size, e / size, d / size

    def project(self, q: rotation.Quat, cam: tuple[Column, Column, Column], point: tuple[Column, Column, Column], least: float = 0.2) -> tuple[Column, Column]:
        """Pixel of a point; null where it lies less than ``least`` before the camera."""
        m = rotation.matrix(q)
        rel = tuple(a - b for a, b in zip(point, cam))
        ahead, right, down = (m[0][k] * rel[0] + m[1][k] * rel[1] + m[2][k] * rel[2] for k in range(3))
        u, v = self.pixel(right / ahead, down / ahead)
        return F.when(ahead > least, u), F.when(ahead > least, v)


def on_ground(ray: tuple[Column, Column, Column], cam: tuple[Column, Column, Column], down: Column) -> tuple[Column, ...]:
    """Where a ray meets the level plane at ``down``; the camera's own position where it does not point down."""
    s = (down - cam[2]) / ray[2]
    return tuple(F.when(ray[2] > 0, c + s * v).otherwise(c) for c, v in zip(cam, ray))

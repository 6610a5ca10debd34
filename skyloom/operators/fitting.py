"""Least squares and searches over whole tables: each round is one aggregate, the driver solves a few numbers.

A model is a function from parameters to column expressions, so residuals and their differences are
computed where the rows are, and a round moves a triangle of sums to the driver, whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Residuals = Callable[[Sequence[float]], list[Column]]


def normal_equations(df: DataFrame, residuals: Residuals, x: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, float, int]:
    """J'J, J'r, r'r and the number of rows at ``x``, with derivatives by central differences; rows with a null residual take no part."""
    n = len(x)
    at = [residuals(list(x))] + [residuals(list(x + d * e)) for e in np.eye(n) * step for d in (1, -1)]
    m = len(at[0])
    rows = df.select(*(c.alias(f"r{k}_{i}") for k, cs in enumerate(at) for i, c in enumerate(cs)))
    rows = rows.dropna()
    each = [[F.col(f"r0_{i}")] + [(F.col(f"r{2 * k + 1}_{i}") - F.col(f"r{2 * k + 2}_{i}")) / (2 * step) for k in range(n)] for i in range(m)]
    sums = [F.sum(sum(r[a] * r[b] for r in each)).alias(f"s{a}_{b}") for a in range(n + 1) for b in range(a + 1)]
    got = rows.agg(*sums, F.count("*").alias("n")).first()
    s = np.zeros((n + 1, n + 1))
    for a in range(n + 1):
        for b in range(a + 1):
            s[a, b] = s[b, a] = got[f"s{a}_{b}"] or 0.0
    return s[1:, 1:], s[1:, 0], s[0, 0], got["n"]


def linear_normal_equations(df: DataFrame, columns: Sequence[str], matrix: Callable[[Sequence[float]], np.ndarray], step: float):
    """The same sums for residuals that are a matrix of the parameters times a row's columns, as a function of the parameters.

    The columns' products are added up once; whatever the parameters, all sums follow from them.
    """
    m = len(columns)
    rows = df.select(*columns).dropna()
    got = rows.agg(*(F.sum(F.col(columns[a]) * F.col(columns[b])).alias(f"s{a}_{b}") for a in range(m) for b in range(a + 1)), F.count("*").alias("n")).first()
    s = np.zeros((m, m))
    for a in range(m):
        for b in range(a + 1):
            s[a, b] = s[b, a] = got[f"s{a}_{b}"] or 0.0

    def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
        parts = [matrix(list(x))] + [(matrix(list(x + e)) - matrix(list(x - e))) / (2 * step) for e in np.eye(len(x)) * step]
        t = np.array([[np.sum((p @ s) * q) for q in parts] for p in parts])
        return t[1:, 1:], t[1:, 0], t[0, 0], got["n"]

    return at


def least_squares(df: DataFrame, residuals: Residuals, start: Sequence[float], *, rounds: int = 30, step: float = 1e-5, ftol: float = 1e-10, linear: tuple | None = None) -> tuple[list[float], float, int]:
    """(parameters, root mean square of the residuals, rows): Gauss-Newton with damping, one aggregate a round.

    ``residuals`` gives the columns of a row's residuals for given parameters. A round that raises the
    sum of squares is taken back and damped more. An empty table leaves the start as it is. Where the
    residuals are linear in a row's columns, ``linear`` names these and gives their matrix for given
    parameters; the table is then read once for all rounds.
    """
    x, damping = np.array(start, dtype=float), 1e-3
    sums = linear_normal_equations(df, *linear, step) if linear else lambda x: normal_equations(df, residuals, x, step)
    h, g, cost, n = sums(x)
    width = len(residuals(list(x)))
    for _ in range(rounds if n else 0):
        new = x - np.linalg.solve(h + damping * np.diag(np.diag(h)) + 1e-12 * np.eye(len(x)), g)
        h2, g2, cost2, _ = sums(new)
        if cost2 < cost:
            done = cost - cost2 <= ftol * cost
            x, h, g, cost, damping = new, h2, g2, cost2, damping / 5
            if done:
                break
        elif damping > 1e6 or cost == 0:
            break
        else:
            damping *= 10
    return x.tolist(), math.sqrt(cost / (n * width)) if n else 0.0, n


def coordinate_search(df: DataFrame, objective: Callable[[Sequence[float]], Column], start: Sequence[float], *, spread: float, least: float, samples: int = 11, shrink: float = 4.0) -> tuple[list[float], float]:
    """(parameters, mean of the objective): each parameter in turn goes to the vertex of a parabola through the means at ``samples`` places.

    The places are spaced evenly over ``spread`` on both sides and measured by one aggregate; after all
    parameters the spread shrinks, until it is below ``least``. Where the parabola has no lowest
    point, or has it outside the places, the best place is taken. An empty table leaves the start.
    """
    x = list(map(float, start))
    mean = lambda p, k: F.avg(objective(p)).alias(f"m{k}")
    while spread >= least:
        for n in range(len(x)):
            places = np.linspace(x[n] - spread, x[n] + spread, samples)
            got = df.agg(*(mean([*x[:n], float(p), *x[n + 1 :]], k) for k, p in enumerate(places))).first()
            if got["m0"] is None:
                return x, 0.0
            y = np.array([got[f"m{k}"] for k in range(samples)])
            c, b, a = np.polynomial.polynomial.polyfit(places - x[n], y, 2)
            low = x[n] - b / (2 * a) if a > 0 else math.inf
            x[n] = float(low if places[0] <= low <= places[-1] else places[int(y.argmin())])
        spread /= shrink
    return x, df.agg(mean(x, 0)).first()["m0"]


def grid_search(df: DataFrame, objective: Callable[[float], Column], low: float, high: float, step: float, *, refinements: int = 3, shrink: float = 0.2) -> tuple[float, float]:
    """(parameter, mean of the objective): the best place of a grid, then of finer ones, five steps to both sides of the last best.

    All places of a grid are measured by one aggregate; ties go to the smaller parameter. An empty table gives the low end and zero.
    """
    best = low, 0.0
    for _ in range(refinements):
        places = [low + k * step for k in range(math.floor((high - low) / step + 0.1) + 1)]
        got = df.agg(*(F.avg(objective(p)).alias(f"m{k}") for k, p in enumerate(places))).first()
        if got["m0"] is None:
            return best
        best = min(((p, got[f"m{k}"]) for k, p in enumerate(places)), key=lambda x: (x[1], x[0]))
        step *= shrink
        low, high = best[0] - step * 5, best[0] + step * 5
    return best


def mount_rotation(ypr: Sequence[float]) -> np.ndarray:
    """The matrix of yaw, pitch, roll in radians: turns about z, then y, then x of the moving frame."""
    (sy, sp, sr), (cy, cp, cr) = ([f(a) for a in ypr] for f in (math.sin, math.cos))
    z = np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]])
    y = np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]])
    x = np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]])
    return z @ y @ x


def gyro_residuals(camera: Sequence[str], body: Sequence[str]) -> Residuals:
    """Body rates minus the camera's rates turned by a mount of yaw, pitch, roll."""

    def at(ypr):
        m = mount_rotation(ypr)
        return [F.col(body[i]) - sum(F.lit(float(m[i, k])) * F.col(camera[k]) for k in range(3)) for i in range(3)]

    return at


def gyro_matrix(camera: Sequence[str], body: Sequence[str]) -> tuple[list[str], Callable[[Sequence[float]], np.ndarray]]:
    """The same residuals as a matrix times the body's and the camera's rates."""
    return [*body, *camera], lambda ypr: np.hstack([np.eye(3), -mount_rotation(ypr)])


def gyro_error(camera: Sequence[str], body: Sequence[str]) -> Callable[[Sequence[float]], Column]:
    """The length of those differences."""
    residuals = gyro_residuals(camera, body)
    return lambda ypr: F.sqrt(sum(c * c for c in residuals(ypr)))


def horizon_residuals(roll: str, pitch: str, body_pitch: str, body_roll: str) -> Residuals:
    """Seen roll and pitch of the horizon minus those that the body's attitude and a mount of yaw, pitch, roll give."""

    def at(ypr):
        m = mount_rotation(ypr)
        sp, cp, sr, cr = F.sin(body_pitch), F.cos(body_pitch), F.sin(body_roll), F.cos(body_roll)
        down = (-sp, sr * cp, cr * cp)
        x, y, z = (sum(F.lit(float(m[k, i])) * down[k] for k in range(3)) for i in range(3))
        wrap = lambda c: F.pmod(c + math.pi, F.lit(2 * math.pi)) - math.pi
        return [wrap(F.col(roll) - F.atan2(y, z)), F.col(pitch) + F.asin(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))]

    return at

"""Per-frame filters with state, run on streams and, by the same steps, on tables.

A filter is a class with ``columns`` (its outputs), ``start()`` (its first state, a list of
doubles) and ``step(state, t, x)`` -> (state, values or None); None emits nothing for that row.
Rows of a key arrive in time order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class RunningMean:
    """Mean of all rows so far; beyond ``cap`` rows old ones fade."""

    cap: int = 1000
    columns = ("mean",)

    def start(self):
        return [0.0, 0.0]

    def step(self, s, t, x):
        n = min(s[0] + 1, self.cap)
        mean = s[1] + (x - s[1]) / n
        return [n, mean], (mean,)


@dataclass(frozen=True)
class Welford:
    """Running mean and population variance."""

    columns = ("mean", "var")

    def start(self):
        return [0.0, 0.0, 0.0]

    def step(self, s, t, x):
        n, mean, m2 = s[0] + 1, s[1], s[2]
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
        return [n, mean, m2], (mean, m2 / n)


@dataclass(frozen=True)
class WarmUpLowPass:
    """Low pass whose window grows with the rows seen, up to ``seconds`` at ``fps``."""

    fps: float = 30.0
    seconds: float = 15.0
    columns = ("low",)

    def start(self):
        return [0.0, 0.0]

    def step(self, s, t, x):
        frames = min((s[0] + 1) / self.fps, self.seconds) * self.fps
        low = x if s[0] == 0 else (frames - 1) / frames * s[1] + x / frames
        return [s[0] + 1, low], (low,)


@dataclass(frozen=True)
class AsymmetricEwma:
    """Rises with ``attack``, falls with ``decay``."""

    attack: float = 0.9
    decay: float = 0.98
    columns = ("level",)

    def start(self):
        return [0.0]

    def step(self, s, t, x):
        k = self.attack if x > s[0] else self.decay
        y = k * s[0] + (1 - k) * x
        return [y], (y,)


@dataclass(frozen=True)
class FastSlow:
    """Fast, slow and background averages with a decaying maximum of their difference."""

    fast: float = 0.5
    slow: float = 0.96
    back: float = 0.99
    columns = ("fast_avg", "slow_avg", "back_avg", "peak")

    def start(self):
        return [0.0, 0.0, 0.0, 0.0, 0.0]

    def step(self, s, t, x):
        f, w, b = (x, x, x) if s[0] == 0 else tuple(k * v + (1 - k) * x for k, v in zip((self.fast, self.slow, self.back), s[1:4]))
        peak = max(0.95 * s[4], abs(f - w))
        return [1.0, f, w, b, peak], (f, w, b, peak)


@dataclass(frozen=True)
class SinceEmitted:
    """Emits a row when ``interval`` seconds or ``distance`` in value have passed since the last emitted one."""

    interval: float = 1.0
    distance: float = float("inf")
    columns = ("gap",)

    def start(self):
        return [0.0, 0.0, 0.0]

    def step(self, s, t, x):
        if s[0] == 0:
            return [1.0, t, x], (0.0,)
        if t - s[1] >= self.interval or abs(x - s[2]) >= self.distance:
            return [1.0, t, x], (t - s[1],)
        return s, None


@dataclass(frozen=True)
class Rates:
    """Change over time since the row before; beyond ``limit`` it counts as 0."""

    limit: float = float("inf")
    columns = ("rate",)

    def start(self):
        return [0.0, 0.0, 0.0]

    def step(self, s, t, x):
        rate = (x - s[2]) / (t - s[1]) if s[0] and t > s[1] else 0.0
        return [1.0, t, x], (0.0 if abs(rate) > self.limit else rate,)


@dataclass(frozen=True)
class Stabilizer:
    """Smoothed path that catches up with the accumulated motion (T13): the correction is smooth minus raw."""

    smooth: float = 0.9
    catch_up: float = 0.02
    columns = ("path", "smoothed", "correction")

    def start(self):
        return [0.0, 0.0]

    def step(self, s, t, x):
        path = s[0] + x
        smoothed = self.smooth * s[1] + (1 - self.smooth) * path
        smoothed += self.catch_up * (path - smoothed)
        return [path, smoothed], (path, smoothed, smoothed - path)


@dataclass(frozen=True)
class StreamingModes:
    """Dynamic modes of delay vectors, updated row by row.

    The bases of inputs and outputs grow by Gram-Schmidt, the small matrices are updated, and
    bases above ``rank`` are compressed to their strongest directions after the update. Emits the
    modulus of the leading eigenvalue.
    """

    delay: int = 4
    rank: int = 3
    epsilon: float = 1e-8
    columns = ("modulus",)

    def start(self):
        return [0.0]

    def _unpack(self, s):
        n, k = self.delay, int(s[0])
        window = s[1 : 1 + min(k, n)]
        rest = s[1 + len(window) :]
        if not rest:
            return k, window, None
        rx, ry = int(rest[0]), int(rest[1])
        v, out, at = np.array(rest[2:]), [], 0
        for shape in ((n, rx), (n, ry), (rx, rx), (ry, ry), (ry, rx)):
            out.append(v[at : at + shape[0] * shape[1]].reshape(shape))
            at += shape[0] * shape[1]
        return k, window, out

    def step(self, s, t, x):
        k, window, m = self._unpack(s)
        new = [*window, x][-self.delay :]
        value = None
        if k >= self.delay:
            m = self._update(m, np.array(window, dtype=float), np.array(new, dtype=float))
        state = [float(k + 1), *new]
        if m is not None:
            qx, qy, gx, gy, a = m
            state += [float(qx.shape[1]), float(qy.shape[1]), *(float(v) for z in m for v in z.ravel())]
            step = qx.T @ qy @ a @ np.linalg.pinv(gx)
            value = float(np.abs(np.linalg.eigvals(step)).max())
        return state, None if value is None else (value,)

    def _grow(self, q, v, size):
        e = v.copy()
        for _ in range(5):
            e = e - q @ (q.T @ e)
        n = np.linalg.norm(e)
        return np.column_stack([q, e / n]) if n / size > self.epsilon and q.shape[1] < self.delay else q

    def _update(self, m, x, y):
        nx, ny = np.linalg.norm(x) or 1.0, np.linalg.norm(y) or 1.0
        if m is None:
            return [(x / nx)[:, None], (y / ny)[:, None], np.array([[nx * nx]]), np.array([[ny * ny]]), np.array([[nx * ny]])]
        qx, qy, gx, gy, a = m
        qx, qy = self._grow(qx, x, nx), self._grow(qy, y, ny)
        dx, dy = qx.shape[1] - gx.shape[0], qy.shape[1] - gy.shape[0]
        gx, gy, a = np.pad(gx, (0, dx)), np.pad(gy, (0, dy)), np.pad(a, ((0, dy), (0, dx)))
        xt, yt = qx.T @ x, qy.T @ y
        a, gx, gy = a + np.outer(yt, xt), gx + np.outer(xt, xt), gy + np.outer(yt, yt)
        if qx.shape[1] > self.rank:
            w, v = np.linalg.eigh(gx)
            v, w = v[:, ::-1][:, : self.rank], w[::-1][: self.rank]
            qx, a, gx = qx @ v, a @ v, np.diag(w)
        if qy.shape[1] > self.rank:
            w, v = np.linalg.eigh(gy)
            v, w = v[:, ::-1][:, : self.rank], w[::-1][: self.rank]
            qy, a, gy = qy @ v, v.T @ a, np.diag(w)
        return [qx, qy, gx, gy, a]


@dataclass(frozen=True)
class WindowModes:
    """Dynamic modes refitted to the last ``window`` rows, as delay vectors (T10); emits the modulus of the slowest mode."""

    window: int = 40
    delay: int = 4
    rank: int = 3
    columns = ("modulus",)

    def start(self):
        return []

    def step(self, s, t, x):
        from ..operators.estimators import dmd

        s = [*s, x][-self.window :]
        if len(s) < self.delay + 2:
            return s, None
        v = np.array(s, dtype=float)
        snaps = np.array([v[i : len(v) - self.delay + 1 + i] for i in range(self.delay)])
        values, _ = dmd(snaps, self.rank)
        return s, (float(np.abs(values[0])),)

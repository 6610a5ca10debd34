"""Poses from points and homographies: resection (V03), decomposition (E25) and lens distortion from flow."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adjustment import linearised, pieces, rotations, vectors, whole_chains
from .geometry import consensus, homography, transfer
from .graph import settled, spread

#: The monomials of a point's homogeneous coordinates, and what of the pixel they are summed with.
PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]
#: Pairs of pixels in a task of the lens fit.
FLOW = 200_000
POSE = ("r0", "r1", "r2", "c0", "c1", "c2")


def moments(obs: DataFrame, by: str, lens) -> DataFrame:
    """(by, n, centre, spread, and 40 sums): all that the direct linear transform of an image needs, added up on the way."""
    f, cu, cv = lens[:3]
    own = obs.groupBy(by).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"mid_{c}") for c in ("x0", "x1", "x2")), F.greatest(*(F.max(c) - F.min(c) for c in ("x0", "x1", "x2")), F.lit(1e-9)).alias("spread"),
        *(((F.avg(c) - mid) / f).alias(f"mid_{c}") for c, mid in (("u", cu), ("v", cv))), F.greatest(*((F.max(c) - F.min(c)) / f for c in "uv"), F.lit(1e-9)).alias("wide"),
    )
    rows = obs.join(own, by)
    x = [(F.col(c) - F.col(f"mid_{c}")) / F.col("spread") for c in ("x0", "x1", "x2")] + [F.lit(1.0)]
    u, v = (((F.col(c) - mid) / f - F.col(f"mid_{c}")) / F.col("wide") for c, mid in (("u", cu), ("v", cv)))
    sums = [F.sum(x[a] * x[b] * w).alias(f"{name}{a}{b}") for name, w in (("o", F.lit(1.0)), ("u", u), ("v", v), ("q", u * u + v * v)) for a, b in PAIRS]
    sums = rows.groupBy(by).agg(*sums)
    return own.join(sums, by)


def linear_pose(m: dict) -> np.ndarray | None:
    """Rotation vector and position from an image's moments, by the direct linear transform; null where the points do not fix it.

    Points in a plane are told by the smallest spread of their coordinates and solved as a
    homography of the plane, from four on; others need six. Of the two signs the one stands that puts
    the points' middle before the camera.
    """
    s = {}
    for name in "ouvq":
        s[name] = np.zeros((4, 4))
        for a, b in PAIRS:
            s[name][a, b] = s[name][b, a] = m[f"{name}{a}{b}"]
    cov = s["o"][:3, :3] / m["n"]
    size, axes = np.linalg.eigh(cov)
    flat = size[0] < 1e-10 * size[2]
    if size[1] < 1e-8 * size[2] or m["n"] < (4 if flat else 6):
        return None
    # columns of ``base``: the frame in which the unknown 3 x 3 or 3 x 4 matrix is expressed
    base = np.zeros((4, 3 if flat else 4))
    base[:3, : base.shape[1] - 1] = axes[:, [2, 1]] if flat else np.eye(3)
    base[3, -1] = 1
    o, u, v, q = (base.T @ s[k] @ base if not flat else np.linalg.pinv(base) @ s[k] @ np.linalg.pinv(base).T for k in "ouvq")
    z = np.zeros_like(o)
    lines = np.block([[o, z, -u], [z, o, -v], [-u, -v, q]])
    p = np.linalg.eigh(lines)[1][:, 0].reshape(3, -1)
    p = np.array([[m["wide"], 0, m["mid_u"]], [0, m["wide"], m["mid_v"]], [0, 0, 1]]) @ p
    if flat:
        # two columns of the rotation and the shift
        scale = (np.linalg.norm(p[:, 0]) + np.linalg.norm(p[:, 1])) / 2
        p = p / scale * (1 if p[2, 2] > 0 else -1)
        a, b = p[:, 0], p[:, 1]
        rot = np.column_stack([a, b, np.cross(a, b)]) @ np.column_stack([axes[:, 2], axes[:, 1], np.cross(axes[:, 2], axes[:, 1])]).T
    else:
        p = p * (1 if p[2, 3] > 0 else -1)
        rot, scale = p[:, :3], np.cbrt(max(1e-300, np.linalg.det(p[:, :3])))
        if np.linalg.det(p[:, :3]) <= 0:
            return None
        p = p / scale
        rot = p[:, :3]
    w, _, t = np.linalg.svd(rot)
    rot = w @ np.diag([1, 1, np.sign(np.linalg.det(w @ t))]) @ t
    mid = np.array([m["mid_x0"], m["mid_x1"], m["mid_x2"]])
    place = mid - rot.T @ p[:, -1] * m["spread"]
    if not np.isfinite(place).all() or (rot @ (mid - place))[2] <= 0:
        return None
    return np.r_[vectors(rot[None])[0], place]


def three_point_poses(x: np.ndarray, rays: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rotation, position) of the cameras that see three points along three unit rays: a quartic in a ratio of distances."""
    a, b, c = (np.linalg.norm(x[i] - x[j]) for i, j in ((1, 2), (0, 2), (0, 1)))
    ca, cb, cg = rays[1] @ rays[2], rays[0] @ rays[2], rays[0] @ rays[1]
    if min(a, b, c) < 1e-9:
        return []
    k, l = (a * a - c * c) / (b * b), (a * a + c * c) / (b * b)
    p, q = (b * b - c * c) / (b * b), (b * b - a * a) / (b * b)
    quartic = [
        (k - 1) ** 2 - 4 * c * c / (b * b) * ca * ca,
        4 * (k * (1 - k) * cb - (1 - l) * ca * cg + 2 * c * c / (b * b) * ca * ca * cb),
        2 * (k * k - 1 + 2 * k * k * cb * cb + 2 * p * ca * ca - 4 * l * ca * cb * cg + 2 * q * cg * cg),
        4 * (-k * (1 + k) * cb + 2 * a * a / (b * b) * cg * cg * cb - (1 - l) * ca * cg),
        (1 + k) ** 2 - 4 * a * a / (b * b) * cg * cg,
    ]
    out = []
    for root in np.roots(quartic):
        v = root.real
        if abs(root.imag) > 1e-6 * (1 + abs(v)) or v <= 0:
            continue
        below = 2 * (cg - v * ca)
        if abs(below) < 1e-12:
            continue
        u = ((-1 + k) * v * v - 2 * k * cb * v + 1 + k) / below
        first = b * b / (1 + v * v - 2 * v * cb)
        if u <= 0 or first <= 0:
            continue
        y = rays * (math.sqrt(first) * np.array([1, u, v]))[:, None]
        mx, my = x.mean(axis=0), y.mean(axis=0)
        w, _, t = np.linalg.svd((y - my).T @ (x - mx))
        rot = w @ np.diag([1, 1, np.sign(np.linalg.det(w @ t))]) @ t
        out.append((rot, mx - rot.T @ my))
    return out


def few_points_pose(x: np.ndarray, uv: np.ndarray) -> np.ndarray | None:
    """A pose from four or five points that do not lie in a plane: three-point poses, the one that fits the others best."""
    rays = np.column_stack([uv, np.ones(len(uv))])
    unit = rays / np.linalg.norm(rays, axis=1)[:, None]
    best, least = None, math.inf
    for three in combinations(range(len(x)), 3):
        for rot, place in three_point_poses(x[list(three)], unit[list(three)]):
            at = (x - place) @ rot.T
            if (at[:, 2] > 0).all():
                off = ((at[:, :2] / at[:, 2:] - uv) ** 2).sum()
                if off < least:
                    best, least = np.r_[vectors(rot[None])[0], place], off
    return best


def solve_poses(obs: DataFrame, lens, by: str = "image", *, rounds: int = 4) -> DataFrame:
    """(by, n, r0 r1 r2, c0 c1 c2, rms): the pose of each image from the points that it sees, null where they do not give one.

    ``obs``: (by, x0 x1 x2, u, v), places and pixels; ``lens`` as in the bundle adjustment. A linear
    solution (distortion left out) is refined by ``rounds`` of Gauss-Newton over all observations
    with the whole lens; a point must lie before the camera in it. Images with fewer than four rows, with points in a line, and
    such as have no solution get null poses and errors. Rows with nulls take no part. Each step adds
    up sums by image, so an image may have any share of the rows; only images of four or five rows are
    looked at as rows.
    """
    lens = np.array(lens, dtype=float)
    obs = settled(obs.select(by, "x0", "x1", "x2", "u", "v").dropna())
    kind = obs.schema[by].dataType.simpleString()
    f, cu, cv = lens[:3]
    summed = settled(moments(obs, by, lens))

    def linear(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            found = [linear_pose(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("n"), pa.array([None if p is None else p.tolist() for p in found], pa.list_(pa.float64()))], [by, "n", "pose"])

    def few(g):
        import pandas as pd

        p = few_points_pose(g[["x0", "x1", "x2"]].to_numpy(), (g[["u", "v"]].to_numpy() - [cu, cv]) / f)
        return pd.DataFrame({by: [g[by].iloc[0]], "own": [None if p is None else p.tolist()]})

    first = summed.mapInArrow(linear, f"`{by}` {kind}, n long, pose array<double>")
    small = first.filter("pose is null and n in (4, 5)").select(by)
    own = obs.join(small, by, "left_semi").groupBy(by).applyInPandas(few, f"`{by}` {kind}, own array<double>")
    state = settled(first.join(own, by, "left").select(by, "n", F.coalesce("pose", "own").alias("pose")))

    def parts(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            c = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
            cam, x, uv = np.array(batch.column("pose").to_pylist()), np.column_stack([c("x0"), c("x1"), c("x2")]), np.column_stack([c("u"), c("v")])
            res, jac, _, _ = linearised(cam, x, uv, lens)
            both = np.concatenate([jac, res[:, :, None]], axis=2)
            squares = (both.transpose(0, 2, 1) @ both).reshape(-1, 49)
            yield pa.RecordBatch.from_arrays([batch.column(by), *(pa.array(squares[:, k]) for k in range(49))], [by, *(f"s{k}" for k in range(49))])

    def step(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                s, p = np.array([r[f"s{k}"] for k in range(49)]).reshape(7, 7), np.array(r["pose"])
                # turns and shifts weigh alike, however far the camera stands
                size = np.sqrt(np.maximum(np.diag(s)[:6], 1e-300))
                d = -np.linalg.lstsq(s[:6, :6] / np.outer(size, size) + 1e-15 * np.eye(6), s[:6, 6] / size, rcond=None)[0] / size
                out.append(np.r_[vectors(rotations(d[None, :3]) @ rotations(p[None, :3]))[0], p[3:] + d[3:]].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(out, pa.list_(pa.float64()))], [by, "new"])

    def sums_at(state: DataFrame) -> DataFrame:
        each = obs.join(state.filter("pose is not null").select(by, "pose"), by).mapInArrow(parts, f"`{by}` {kind}, " + ", ".join(f"s{k} double" for k in range(49)))
        return each.groupBy(by).agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(49)))

    for _ in range(rounds):
        moved = sums_at(state).join(state.select(by, "pose"), by).mapInArrow(step, f"`{by}` {kind}, new array<double>")
        state = settled(state.join(moved, by, "left").select(by, "n", F.coalesce("new", "pose").alias("pose")))
    error = sums_at(state).select(by, F.sqrt(F.col("s48")).alias("root"))
    out = state.join(error, by, "left").withColumn("rms", F.col("root") / F.sqrt("n"))
    return out.select(by, "n", *(F.col("pose")[k].alias(c) for k, c in enumerate(POSE)), "rms")


def decomposed(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rotation, shift over distance, normal) of the up to four motions that give a homography of rays.

    Scaled to a middle singular value of one, H = R + t n'; the two planes through its middle singular
    direction that H keeps rigid give two rotations, and either sign of the normal. A homography
    that is a rotation has that one alone.
    """
    h = h / np.linalg.svd(h)[1][1]
    h = h if np.linalg.det(h) > 0 else -h
    _, s, vt = np.linalg.svd(h)
    v1, v2, v3 = vt
    high, low = math.sqrt(max(0.0, s[0] ** 2 - 1)), math.sqrt(max(0.0, 1 - s[2] ** 2))
    wide = math.hypot(high, low)
    if wide < 1e-6:
        w, _, t = np.linalg.svd(h)
        return [(w @ t, np.zeros(3), np.zeros(3))]
    out = []
    for sign in (1, -1):
        u = (low * v1 + sign * high * v3) / wide
        a = np.column_stack([v2, u, np.cross(v2, u)])
        b = np.column_stack([h @ v2, h @ u, np.cross(h @ v2, h @ u)])
        rot, normal = b @ a.T, np.cross(v2, u)
        shift = (h - rot) @ normal
        out += [(rot, shift, normal), (rot, -shift, -normal)]
    return out


def homography_motions(df: DataFrame, key: str, h: str, lens) -> DataFrame:
    """(key, k, r0 r1 r2, t0 t1 t2, n0 n1 n2): the motions of each pixel homography (nine numbers by rows), as rotation vector, shift and normal.

    Null, short, non-finite and singular homographies have no rows.
    """
    f, cu, cv = lens[:3]
    k = np.array([[f, 0, cu], [0, f, cv], [0, 0, 1]])
    inverse = np.linalg.inv(k)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x is None or len(x) != 9 or not all(c is not None and math.isfinite(c) for c in x):
                    continue
                m = inverse @ np.array(x).reshape(3, 3) @ k
                if np.linalg.svd(m)[1][2] > 1e-9:
                    rows += [(i, n, *vectors(r[None])[0], *t, *normal) for n, (r, t, normal) in enumerate(decomposed(m))]
            columns = list(zip(*rows)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=batch.column(0).type if n == 0 else pa.int32() if n == 1 else pa.float64()) for n, c in enumerate(columns)], [n for n, _ in fields])

    fields = [(key, df.schema[key].dataType.simpleString()), ("k", "int"), *((f"{v}{i}", "double") for v in "rtn" for i in range(3))]
    return df.select(key, F.col(h).cast("array<double>").alias("h")).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def nearest_motion(motions: DataFrame, key: str, expected) -> DataFrame:
    """The motion of each key whose rotation is nearest to the expected one (three columns); ties to the smaller k."""
    off = sum((F.col(f"r{i}") - c) ** 2 for i, c in enumerate(expected))
    return motions.withColumn("off", F.sqrt(off)).groupBy(key).agg(F.min_by(F.struct(*(c for c in motions.columns if c != key), "off"), F.struct(F.round("off", 12), F.col("k"))).alias("m")).select(key, "m.*")


def undistorted(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Ideal places of distorted ones under radial terms k1, k2, k3."""
    far, s = p[:, 0] * p[:, 0] + p[:, 1] * p[:, 1], 1.0
    for _ in range(12):
        r = far * s * s
        s = 1 / (1 + r * (k[0] + r * (k[1] + r * k[2])))
    return p * s[:, None]


def distorted(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    r = (p * p).sum(axis=1)[:, None]
    return p * (1 + r * (k[0] + r * (k[1] + r * k[2])))


def grams(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The Gram matrix of each frame's columns of ``m`` (quantity, u or v, row)."""
    each = ((m[:, 0, low:high], m[:, 1, low:high]) for low, high in zip(edges, edges[1:]))
    return np.stack([u @ u.T + v @ v.T for u, v in each])


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares solutions of symmetric systems, each scaled to a unit diagonal; directions that the rows do not fix stay zero."""
    size = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300))
    return np.linalg.pinv(a / (size[:, :, None] * size[:, None]), rcond=1e-13, hermitian=True) @ (b / size[:, :, None]) / size[:, :, None]


def flow_sums(a: np.ndarray, b: np.ndarray, edges: np.ndarray, k: np.ndarray, f: float) -> np.ndarray:
    """(frames, 4, 4): each frame's normal equations of the three radial terms and its squared error, its homography solved and eliminated.

    ``a`` and ``b`` are the places of frames that lie one after another, cut at ``edges``; all of them are worked on at once, and
    a homography is done when its steps are below 1e-9 (three at most). A frame whose errors are not finite has NaN.
    """
    sizes, n = np.diff(edges), len(a)
    frame = np.repeat(np.arange(len(sizes)), sizes)

    def scaled(p):
        """Places about their frame's middle in units of their spread, and the transforms that do it."""
        mid = np.add.reduceat(p, edges[:-1]) / sizes[:, None]
        x, y = (p - mid[frame]).T
        s = np.sqrt(2) / np.maximum(1e-12, np.add.reduceat(np.sqrt(x * x + y * y), edges[:-1]) / sizes)
        t = np.zeros((len(mid), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2], t[:, 2, 2] = -s[:, None] * mid, 1
        return x * s[frame], y * s[frame], t

    with np.errstate(all="ignore"):
        ideal, m = undistorted(a, k), np.zeros((12, 2, n))
        (x, y, tx), (u, v, ty) = scaled(ideal), scaled(undistorted(b, k))
        for c, w in enumerate((x, y, 1.0)):
            m[c, 0] = m[c + 3, 1] = w
            m[c + 6, 0], m[c + 6, 1] = -u * w, -v * w
        first = grams(m[:9], edges)
        fine = np.isfinite(first).all(axis=(1, 2))
        first[~fine], ty[~fine] = np.eye(9), np.eye(3)
        h = np.linalg.inv(ty) @ np.linalg.eigh(first)[1][:, :, 0].reshape(-1, 3, 3) @ tx
        h = (h / h[:, 2:, 2:]).reshape(-1, 9)[:, :8]
        x, y = np.ascontiguousarray(ideal.T)
        seen = np.ascontiguousarray(b.T)

        def summed(of_k: bool) -> np.ndarray:
            """Gram matrices of the errors in pixels (last) and their derivatives by the homography and, if wanted, the radial terms."""
            g = h[frame].T
            z = g[6] * x + g[7] * y + 1
            z = 1 / np.where(np.abs(z) < 1e-12, 1e-12, z)
            q = (g[0] * x + g[1] * y + g[2]) * z, (g[3] * x + g[4] * y + g[5]) * z
            r = q[0] * q[0] + q[1] * q[1]
            wide, slope = 1 + r * (k[0] + r * (k[1] + r * k[2])), 2 * f * (k[0] + r * (2 * k[1] + r * 3 * k[2]))
            xz, yz = x * z, y * z
            if of_k:
                # the ideal first place gives way along its radius
                r0 = x * x + y * y
                along = -z / (1 + r0 * (3 * k[0] + r0 * (5 * k[1] + r0 * 7 * k[2])))
                tilt = g[6] * x + g[7] * y
                way = [(g[0] * x + g[1] * y - q[0] * tilt) * along, (g[3] * x + g[4] * y - q[1] * tilt) * along]
            for i in range(2):
                # by the ideal second place
                d = [slope * q[i] * q[0], slope * q[i] * q[1]]
                d[i] += f * wide
                lean = -(d[0] * q[0] + d[1] * q[1])
                m[0, i], m[1, i], m[2, i], m[3, i], m[4, i], m[5, i] = d[0] * xz, d[0] * yz, d[0] * z, d[1] * xz, d[1] * yz, d[1] * z
                m[6, i], m[7, i], m[8, i] = lean * xz, lean * yz, (q[i] * wide - seen[i]) * f
                if of_k:
                    here, there = f * q[i] * r, (d[0] * way[0] + d[1] * way[1]) * r0
                    for c in range(3):
                        m[9 + c, i] = here + there
                        here, there = here * r, there * r0
            out = grams(m if of_k else m[:9], edges)
            fine[~np.isfinite(out).all(axis=(1, 2))] = False
            out[~fine] = np.eye(out.shape[1])
            return out

        for _ in range(3):
            s = summed(False)
            step = solved(s[:, :8, :8], s[:, :8, 8:])[:, :, 0]
            h = h - step
            if np.abs(step).max() < 1e-9:
                break
        s = summed(True)[:, [*range(8), 9, 10, 11, 8]][:, :, [*range(8), 9, 10, 11, 8]]
        free = s[:, 8:, 8:]
        free[:, :, :3] -= s[:, 8:, :8] @ solved(s[:, :8, :8], s[:, :8, 8:11])
        free[:, :3, 3] = free[:, 3, :3]
        free[~fine] = np.nan
        return free


def lens_from_flow(pairs: DataFrame, by: str, lens, *, least: int = 12, reach: float = 3.0, rounds: int = 10, ftol: float = 1e-8) -> tuple[list[float], float, int]:
    """((k1, k2, k3), root mean square in pixels, pairs used): the radial distortion under which each frame's flow is one homography.

    ``pairs``: (by, u0, v0, u1, v1), pixels before and after. A pair's error is taken where it was
    seen: the ideal first place moved by the frame's homography and distorted again, against the
    second pixel, so that no distortion wins by shrinking the picture. A round solves each frame's
    homography where its rows are, eliminates it, and leaves one 3 x 3 system a frame; their sum is
    one aggregate, and the driver solves it. Pairs off by more than ``reach`` pixels from a frame's
    first, sampled homography take no part, nor do frames with fewer than ``least`` pairs left.
    """
    f, cu, cv = lens[:3]
    kind = pairs.schema[by].dataType.simpleString()
    pixels = ["u0", "v0", "u1", "v1"]
    # pixels without a value go where they are read: a filter on them would be computed before and apart from them
    pairs = pairs.select(by, *pixels).dropna(subset=[by])

    def chosen(batches):
        import pyarrow as pa

        for rows in whole_chains(batches, by):
            full = ~np.any([np.isnan(rows[c]) for c in pixels], axis=0)
            rows = {c: rows[c][full] for c in (by, *pixels)}
            edges = [*np.unique(rows[by], return_index=True)[1], len(rows[by])]
            ok = np.zeros(len(rows[by]), dtype=bool)
            for low, high in zip(edges, edges[1:]):
                own = consensus(*(np.column_stack([rows[c][low:high] for c in side]) for side in (pixels[:2], pixels[2:])), reach)
                ok[low:high] = own & (own.sum() >= least)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c][ok]) for c in (by, *pixels)], [by, *pixels])

    # frames stay in their tasks, so that no round moves a pair
    pairs = settled(spread(pairs, FLOW, by).sortWithinPartitions(by, *pixels).mapInArrow(chosen, f"`{by}` {kind}, " + ", ".join(f"{c} double" for c in pixels)))

    def frame_at(k):
        def frames(batches):
            import pyarrow as pa

            for rows in whole_chains(batches, by):
                for piece in pieces(rows[by]):
                    frame = rows[by][piece]
                    edges = np.r_[np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]]), len(frame)]
                    sums = flow_sums(*((np.stack([rows[c][piece] for c in side], axis=1) - [cu, cv]) / f for side in (pixels[:2], pixels[2:])), edges, k, f)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in sums.reshape(-1, 16).T), pa.array(np.diff(edges))], [*(f"s{i}" for i in range(16)), "n"])

        return frames

    def normal(k):
        each = pairs.mapInArrow(frame_at(k), ", ".join(f"s{i} double" for i in range(16)) + ", n long")
        got = each.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(16)), F.sum("n").alias("n")).first()
        s = np.array([got[f"s{i}"] or 0.0 for i in range(16)]).reshape(4, 4)
        return s[:3, :3], s[:3, 3], s[3, 3], got["n"] or 0

    k, damping = np.zeros(3), 1e-3
    h, g, cost, n = normal(k)
    for _ in range(rounds if n else 0):
        new = k - np.linalg.solve(h + damping * np.diag(np.diag(h)) + 1e-12 * np.eye(3), g)
        h2, g2, cost2, n2 = normal(new)
        if np.isfinite(cost2) and cost2 < cost:
            done = cost - cost2 <= ftol * cost
            k, h, g, cost, damping = new, h2, g2, cost2, damping / 5
            if done:
                break
        elif damping > 1e6:
            break
        else:
            damping *= 10
    return k.tolist(), math.sqrt(cost / (2 * n)) if n else 0.0, n

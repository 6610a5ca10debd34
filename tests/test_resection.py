"""Poses, motions, lenses and mounts that were planted come back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators.adjustment import linearised, rotations, vectors
from skyloom.operators.fitting import coordinate_search, gyro_error, gyro_residuals, horizon_residuals, least_squares, mount_rotation
from skyloom.operators.resection import POSE, decomposed, distorted, few_points_pose, homography_motions, lens_from_flow, nearest_motion, solve_poses, undistorted

LENS = [1200.0, 600.0, 400.0, -0.05, 0.01, 0.001, -0.001, 0.0]
POINTS = "image int, x0 double, x1 double, x2 double, u double, v double"


def seen(rng, n, flat=False, lens=LENS):
    cam = np.r_[rng.normal(0, 0.15, 2), rng.uniform(-3, 3), rng.uniform(-30, 30, 2), rng.uniform(-110, -90)]
    x = np.column_stack([rng.uniform(-40, 40, (n, 2)), rng.uniform(-15, 0, n) if not flat else np.full(n, -4.0)])
    uv = linearised(np.repeat(cam[None], n, axis=0), x, np.zeros((n, 2)), np.array(lens))[0]
    return cam, x, uv


def test_planted_poses_come_back(spark):
    rng = np.random.default_rng(1)
    cases = {0: (40, False), 1: (6, False), 2: (4, False), 3: (5, False), 4: (4, True), 5: (30, True), 6: (3, False), 7: (200, False)}
    want, rows = {}, []
    for k, (n, flat) in cases.items():
        cam, x, uv = seen(rng, n, flat)
        want[k] = cam
        rows += [(k, *map(float, (*a, *b))) for a, b in zip(x, uv)]
    line = [(8, float(t), 2.0 * t, 1.0, 5.0 * t, 3.0 * t) for t in range(10)]
    got = {r.image: r for r in solve_poses(spark.createDataFrame(rows + line + [(0, None, 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0)], POINTS), LENS).collect()}
    for k in (0, 1, 3, 4, 5, 7):
        assert np.allclose(rotations(np.array([[got[k][c] for c in POSE[:3]]])), rotations(want[k][None, :3]), atol=1e-4), k
        assert np.allclose([got[k][c] for c in POSE[3:]], want[k][3:], atol=1e-2) and got[k].rms < 1e-2 and got[k].n == cases[k][0]
    assert got[2].rms < 1e-2  # four points in space fit, though another pose may fit them too
    assert all(got[k][c] is None for k in (6, 8) for c in (*POSE, "rms")) and None not in got
    assert solve_poses(spark.createDataFrame([], POINTS), LENS).count() == 0


def test_few_points_give_the_pose():
    rng = np.random.default_rng(2)
    for _ in range(30):
        cam, x, uv = seen(rng, 5, lens=[1200.0, 600.0, 400.0, 0, 0, 0, 0, 0])
        p = few_points_pose(x, (uv - [600, 400]) / 1200)
        assert np.allclose(rotations(p[None, :3]), rotations(cam[None, :3]), atol=1e-5) and np.allclose(p[3:], cam[3:], atol=1e-3)


def test_motions_of_planted_homographies(spark):
    rng = np.random.default_rng(3)
    k = np.array([[800.0, 0, 320], [0, 800, 240], [0, 0, 1]])
    rows, want = [], {}
    for i in range(20):
        r = rng.normal(0, 0.05, 3)
        n = np.array([*rng.normal(0, 0.2, 2), 1.0])
        n /= np.linalg.norm(n)
        t = rng.normal(0, 0.1, 3) * (i > 0)
        h = rotations(r[None])[0] + np.outer(t, n)
        want[i] = r, t, n
        rows.append((i, (k @ h @ np.linalg.inv(k) * rng.uniform(-3, 3)).ravel().tolist(), *map(float, r + rng.normal(0, 0.002, 3))))
    df = spark.createDataFrame([*rows, (50, None, 0.0, 0.0, 0.0), (51, [1.0] * 9, 0.0, 0.0, 0.0), (52, [1.0] * 4, 0.0, 0.0, 0.0), (53, [float("nan")] * 9, 0.0, 0.0, 0.0)], "id int, h array<double>, e0 double, e1 double, e2 double")
    motions = homography_motions(df, "id", "h", [800.0, 320.0, 240.0])
    best = {m.id: m for m in nearest_motion(motions.join(df.drop("h"), "id"), "id", [F.col(f"e{c}") for c in range(3)]).collect()}
    assert set(best) == set(want)
    for i, (r, t, n) in want.items():
        m = best[i]
        assert np.allclose([m.r0, m.r1, m.r2], r, atol=1e-6)
        assert np.allclose(np.outer([m.t0, m.t1, m.t2], [m.n0, m.n1, m.n2]), np.outer(t, n), atol=1e-6)
    assert motions.groupBy("id").count().filter("count > 4").count() == 0
    h = rotations(np.array([[0.1, -0.2, 0.05]]))[0] + np.outer([0.3, 0.1, -0.1], [0, 0.6, 0.8])
    for rot, t, n in decomposed(h):
        assert np.allclose((rot + np.outer(t, n)) / np.cbrt(np.linalg.det(rot + np.outer(t, n))), h / np.cbrt(np.linalg.det(h)), atol=1e-9)
        assert np.allclose(rot @ rot.T, np.eye(3)) and np.linalg.det(rot) > 0


def test_lens_of_planted_flow(spark):
    rng = np.random.default_rng(4)
    true = np.array([-0.12, 0.03, 0.002])
    f, cu, cv = 500.0, 320.0, 240.0
    rows = []
    for frame in range(12):
        a = np.column_stack([rng.uniform(-0.6, 0.6, 80), rng.uniform(-0.45, 0.45, 80)])
        h = rotations(rng.normal(0, 0.03, (1, 3)))[0] + np.outer(rng.normal(0, 0.05, 3), [0, 0, 1])
        b = np.column_stack([a, np.ones(80)]) @ h.T
        p, q = (distorted(x, true) * f + [cu, cv] + rng.normal(0, 0.05, (80, 2)) for x in (a, b[:, :2] / b[:, 2:]))
        rows += [(frame, *map(float, (*x, *y))) for x, y in zip(p, q)] + [(frame, *map(float, rng.uniform(0, 400, 4))) for _ in range(8)]
    df = spark.createDataFrame([*rows, (99, 1.0, 1.0, 2.0, 2.0), (0, None, 1.0, 1.0, 1.0)], "frame int, u0 double, v0 double, u1 double, v1 double")
    k, rms, n = lens_from_flow(df, "frame", [f, cu, cv], reach=4.0)
    grid = np.column_stack([np.linspace(-0.6, 0.6, 30), np.linspace(-0.45, 0.45, 30)])
    assert np.abs(distorted(grid, np.array(k)) - distorted(grid, true)).max() * f < 1.0 and rms < 0.2 and n > 900
    assert np.allclose(undistorted(distorted(grid, true), true), grid, atol=1e-9)
    assert lens_from_flow(df.limit(0), "frame", [f, cu, cv]) == ([0.0, 0.0, 0.0], 0.0, 0)


@pytest.fixture(scope="module")
def rates(spark):
    rng = np.random.default_rng(5)
    true = [0.12, -0.05, 0.08]
    cam = rng.normal(0, 0.4, (300, 3))
    body = cam @ mount_rotation(true).T + rng.normal(0, 0.002, (300, 3))
    return true, spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(cam, body)], "p double, q double, r double, fp double, fq double, fr double")


def test_mount_from_rates_both_ways(rates):
    true, df = rates
    camera, body = ("p", "q", "r"), ("fp", "fq", "fr")
    x, rms, n = least_squares(df, gyro_residuals(camera, body), [0, 0, 0])
    assert np.allclose(x, true, atol=2e-3) and rms < 0.004 and n == 300
    y, mean = coordinate_search(df, gyro_error(camera, body), [0, 0, 0], spread=0.3, least=0.001)
    assert np.allclose(y, true, atol=5e-3) and mean < 0.01
    assert least_squares(df.limit(0), gyro_residuals(camera, body), [1, 2, 3]) == ([1.0, 2.0, 3.0], 0.0, 0)
    assert coordinate_search(df.limit(0), gyro_error(camera, body), [1, 2, 3], spread=0.3, least=0.1)[0] == [1.0, 2.0, 3.0]


def test_mount_from_the_horizon(spark):
    rng = np.random.default_rng(6)
    true = [0.05, -0.1, 0.03]
    rows = []
    for _ in range(400):
        pitch, roll = rng.uniform(-0.3, 0.3), rng.uniform(-0.8, 0.8)
        down = mount_rotation(true).T @ [-math.sin(pitch), math.sin(roll) * math.cos(pitch), math.cos(roll) * math.cos(pitch)]
        rows.append(tuple(map(float, (math.atan2(down[1], down[2]) + rng.normal(0, 0.002), -math.asin(down[0]) + rng.normal(0, 0.002), pitch, roll))))
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 0.0)], "hr double, hp double, pitch double, roll double")
    x, rms, n = least_squares(df, horizon_residuals("hr", "hp", "pitch", "roll"), [0, 0, 0])
    assert np.allclose(x, true, atol=3e-3) and rms < 0.004 and n == 400
    assert np.allclose(vectors(mount_rotation([0, 0, 0.2])[None])[0], [0.2, 0, 0])


def test_poses_of_far_cameras(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for image in (54_003, 57_311, 59_999):
        part, yaw = rng.choice(20_000, 200, replace=False), image % 7 * 0.1
        n, e, d = want[image] = image % 10 * 30.0, image // 10 * 30.0, -110.0
        for p, z in zip(part, rng.integers(1, 51, 200)):
            x = p % 97 * 3.0, p % 89 * 3.0, -float(z)
            a, b, c = x[0] - n, x[1] - e, x[2] - d
            rows.append((image, *map(float, x), float(1000 * (np.cos(yaw) * a - np.sin(yaw) * b) / c), float(1000 * (np.sin(yaw) * a + np.cos(yaw) * b) / c)))
    obs = spark.createDataFrame(rows, "image long, x0 double, x1 double, x2 double, u double, v double")
    got = {r.image: (r.c0, r.c1, r.c2) for r in solve_poses(obs, [1000.0, 0, 0, 0, 0, 0, 0, 0]).collect()}
    assert all(np.allclose(got[k], v, atol=1e-4) for k, v in want.items())


def test_mount_from_one_reading_of_the_table(spark):
    from skyloom.operators.fitting import gyro_matrix

    rng, m = np.random.default_rng(2), mount_rotation([0.12, -0.05, 0.08])
    cam = rng.normal(0, 1, (400, 3))
    body = cam @ m.T + rng.uniform(-0.01, 0.01, (400, 3))
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(cam, body)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0)], "p double, q double, r double, fp double, fq double, fr double")
    sides = ("p", "q", "r"), ("fp", "fq", "fr")
    x, rms, n = least_squares(df, gyro_residuals(*sides), [0, 0, 0])
    y, rms2, n2 = least_squares(df, gyro_residuals(*sides), [0, 0, 0], linear=gyro_matrix(*sides))
    assert n == n2 == 400 and np.allclose(x, y, atol=1e-8) and abs(rms - rms2) < 1e-9


def test_frames_are_summed_together(monkeypatch):
    from skyloom.operators import geometry
    from skyloom.operators.resection import flow_sums

    rng, f, true = np.random.default_rng(9), 500.0, np.array([-0.12, 0.03, 0.002])
    tried, agreeing = [], geometry.agreeing
    monkeypatch.setattr(geometry, "agreeing", lambda a, b, picks, reach: tried.append(len(picks)) or agreeing(a, b, picks, reach))
    a, b, edges = [], [], [0]
    for n in (60, 12, 30):
        x = np.column_stack([rng.uniform(-0.6, 0.6, n), rng.uniform(-0.45, 0.45, n), np.ones(n)])
        y = x @ (np.eye(3) + rng.normal(0, 0.02, (3, 3))).T
        a.append(distorted(x[:, :2], true))
        b.append(distorted(y[:, :2] / y[:, 2:], true))
        edges.append(edges[-1] + n)
        # all pairs agree with an early sample, so the two hundred are not all tried
        assert geometry.consensus(a[-1] * f, b[-1] * f, 4.0).all() and sum(tried) < 100
        tried.clear()
    both = np.concatenate(a), np.concatenate(b)
    at = flow_sums(*both, np.array(edges), true, f)
    assert at.shape == (3, 4, 4) and np.abs(at[:, 3]).max() < 1e-9
    k, e = true + [0.01, -0.01, 0.005], 1e-5
    apart = [flow_sums(x, y, np.array([0, len(x)]), k, f)[0] for x, y in zip(a, b)]
    here = flow_sums(*both, np.array(edges), k, f)
    assert np.allclose(here, apart, rtol=1e-6)
    # half the slope of a frame's squared error, its homography solved anew each time
    slope = [(flow_sums(*both, np.array(edges), k + e * d, f)[:, 3, 3] - flow_sums(*both, np.array(edges), k - e * d, f)[:, 3, 3]) / (4 * e) for d in np.eye(3)]
    assert np.allclose(here[:, :3, 3], np.transpose(slope), rtol=1e-3, atol=1e-4 * np.abs(slope).max())
    assert np.isnan(flow_sums(both[0] * np.inf, both[1], np.array(edges), k, f)).all()

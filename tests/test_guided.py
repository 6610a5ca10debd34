"""Guided matching: planted matches under predictions that are off by more and more."""

import math
import random

import numpy as np
import pytest

from skyloom.operators.geometry import transfer
from skyloom.operators.guided import candidates, guided_matches, pose_homographies, unique

KEYS = "pair int, id int, vec array<double>, u double, v double, size double"


def turned(yaw, roll=0.0, pitch=0.0):
    c, s = math.cos, math.sin
    z = np.array([[c(yaw), s(yaw), 0], [-s(yaw), c(yaw), 0], [0, 0, 1]])
    x = np.array([[1, 0, 0], [0, c(roll), s(roll)], [0, -s(roll), c(roll)]])
    y = np.array([[c(pitch), 0, -s(pitch)], [0, 1, 0], [s(pitch), 0, c(pitch)]])
    return x @ y @ z


def pixels(rot, pos, points, f=1000.0):
    p = (points - pos) @ rot.T
    return f * p[:, :2] / p[:, 2:] + [2000, 1500]


def test_homography_from_poses_is_the_plane_seen_by_both(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(5):
        a, b = turned(k, 0.1, -0.05), turned(k + 2.5, -0.08, 0.1)
        pa, pb = rng.normal(0, 10, 3) + [0, 0, -120], rng.normal(0, 10, 3) + [0, 0, -110]
        ground = np.column_stack([rng.uniform(-40, 40, (20, 2)), np.full(20, -15.0)])
        rows.append((k, 1000.0, 2000.0, 1500.0, 15.0, a.ravel().tolist(), pa.tolist(), b.ravel().tolist(), pb.tolist()))
        want.append((pixels(a, pa, ground), pixels(b, pb, ground)))
    rows.append((9, 1000.0, 2000.0, 1500.0, 120.0, rows[0][5], [0.0, 0.0, -120.0], rows[0][7], [0.0, 0.0, -110.0]))
    names = "k int, f double, cu double, cv double, ground_m double, a_rot array<double>, a_pos array<double>, b_rot array<double>, b_pos array<double>"
    got = {r.k: r.h for r in pose_homographies(spark.createDataFrame(rows, names), "k").collect()}
    for k, (x, y) in enumerate(want):
        assert np.allclose(transfer(np.array(got[k]).reshape(3, 3), x), y, atol=1e-6)
    assert got[9] is not None  # the ground above the right camera goes two metres below it


def planted(seed, offsets, n=150, stray=60):
    """Pairs whose predictions are off by so many pixels; strays of both sides, and look-alikes far away."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    left, right, predicted = [], [], []
    for pair, off in enumerate(offsets):
        a = r.uniform(0, 2 * math.pi)
        true = np.array([[math.cos(a), -math.sin(a), 2000 - 2000 * math.cos(a) + 1500 * math.sin(a)], [math.sin(a), math.cos(a), 1500 - 2000 * math.sin(a) - 1500 * math.cos(a)], [1e-6, -2e-6, 1]])
        uv = np.column_stack([rng.uniform(800, 3200, n), rng.uniform(600, 2400, n)])
        xy = transfer(true, uv) + rng.normal(0, 0.3, (n, 2))
        vec = rng.normal(0, 1, (n, 16))
        left += [(pair, k, vec[k].tolist(), *map(float, uv[k]), 4.0) for k in range(n)]
        right += [(pair, 1000 + k, (vec[k] + rng.normal(0, 0.02, 16)).tolist(), *map(float, xy[k]), 4.4) for k in range(n)]
        left += [(pair, 500 + k, rng.normal(0, 1, 16).tolist(), r.uniform(0, 4000), r.uniform(0, 3000), 4.0) for k in range(stray)]
        right += [(pair, 2000 + k, (vec[k] + rng.normal(0, 0.02, 16)).tolist(), *map(float, (xy[k] + [1700, 900]) % [4000, 3000]), 4.0) for k in range(stray)]
        right += [(pair, 3000 + k, (vec[k + 60] + 1e-4).tolist(), *map(float, xy[k + 60]), 8.0) for k in range(20)]  # of another size
        shift = np.eye(3)
        shift[0, 2] = off
        predicted.append((pair, (shift @ true / (shift @ true)[2, 2]).ravel().tolist()))
    return left, right, predicted


@pytest.fixture(scope="module")
def found(spark):
    offsets = (3, 50, 200, 700, 1500)
    left, right, predicted = planted(4, offsets)
    frames = spark.createDataFrame(left, KEYS), spark.createDataFrame(right, KEYS), spark.createDataFrame(predicted + [(77, predicted[0][1]), (78, None)], "pair int, h array<double>")
    return offsets, guided_matches(*frames, "pair", reach=5.0, limit=5.0).collect(), frames


def test_planted_matches_come_back_whatever_bin_finds_them(found):
    offsets, rows, _ = found
    for pair in range(len(offsets)):
        mine = [x for x in rows if x.pair == pair]
        good = sum(x.j == 1000 + x.i for x in mine)
        assert good >= 0.85 * 150 and len(mine) - good <= 2, (pair, good, len(mine))
        assert len({x.i for x in mine}) == len({x.j for x in mine}) == len(mine)
    assert {x.pair for x in rows} == set(range(len(offsets)))
    assert max(x.px for x in rows) < 5 and max(x.radius for x in rows if x.pair == 0) == 32


def test_candidates_against_all_pairs_within_the_radius(spark, found):
    _, _, (left, right, predicted) = found
    active = predicted.filter("pair < 2 and h is not null").selectExpr("pair", "h", "64 as radius")
    got = {(x.pair, x.i, x.rn): (x.j, round(x.d, 9)) for x in candidates(left, right, active, "pair").collect()}
    want = {}
    theirs = [r for r in right.collect()]
    for p in active.collect():
        for a in (r for r in left.collect() if r.pair == p.pair):
            at = transfer(np.array(p.h).reshape(3, 3), np.array([[a.u, a.v]]))[0]
            near = sorted((round(math.dist(a.vec, b.vec), 9), b.id) for b in theirs if b.pair == p.pair and math.dist(at, (b.u, b.v)) < 64)
            want |= {(p.pair, a.id, k): (j, d) for k, (d, j) in enumerate(near[:3], 1)}
    assert got == want


def test_no_keypoints_no_predictions_no_fit(spark, found):
    _, _, (left, right, predicted) = found
    assert guided_matches(left.limit(0), right, predicted, "pair", reach=5.0, radii=(32, 64)).count() == 0
    assert guided_matches(left, right, predicted.limit(0), "pair", reach=5.0).count() == 0
    assert guided_matches(left.filter("id < 10"), right, predicted.filter("pair = 0"), "pair", reach=5.0, radii=(32, 64)).count() == 0
    a = np.array([[0, 0], [0, 0.001], [1, 1], [2, 2]])
    assert unique(a, np.array([[5, 5], [6, 6], [5, 5.001], [7, 7]])).tolist() == [True, False, False, True]


def test_chance_fits_do_not_end_the_search_and_shared_places_count(spark):
    rng = np.random.default_rng(8)
    n, few = 200, 60
    uv = rng.uniform(500, 2500, (n, 2)).round()
    uv[n // 2 :] = uv[: n // 2]  # two keypoints at each place
    vec = rng.normal(0, 1, (n, 16))
    left = [(1, k, vec[k].tolist(), *map(float, uv[k]), 4.0) for k in range(n)]
    right = [(1, k, (vec[k] * 1.001).tolist(), float(uv[k, 0]) + 100, float(uv[k, 1]), 4.0) for k in range(n)]
    # right where the prediction looks first: keypoints that are like none, in one homography
    right += [(1, 1000 + k, rng.normal(0, 1, 16).tolist(), float(uv[k, 0]) + 5, float(uv[k, 1]) + 5, 4.0) for k in range(few)]
    frames = spark.createDataFrame(left, KEYS), spark.createDataFrame(right, KEYS), spark.createDataFrame([(1, np.eye(3).ravel().tolist())], "pair int, h array<double>")
    assert {(x.i, x.j) for x in guided_matches(*frames, "pair", reach=3.0, places=False).collect()} == {(k, k) for k in range(n)}
    assert len(guided_matches(*frames, "pair", reach=3.0).collect()) == n // 2

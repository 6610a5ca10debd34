"""Operators without SQL against plain restatements, and worked examples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import angles
from skyloom.functions.camera import Camera
from skyloom.operators import estimators as est
from skyloom.operators import graph, series
from skyloom.operators.joins import asof, interpolate, nearest, within
from skyloom.sources import sinks, terrain


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_worked_angles(spark):
    r = one(spark, angles.dms_to_decimal(F.lit(10), F.lit(10), F.lit(10), F.lit("N")), angles.dms_to_decimal(F.lit(8), F.lit(9), F.lit(10), F.lit("S")))
    assert r[0] == pytest.approx(10.169444444444444) and r[1] == pytest.approx(-8.152777777777779)
    d, m, s = one(spark, *angles.decimal_to_dms(F.lit(50.445891)))
    assert (d, m) == (50, 26) and s == pytest.approx(113019 / 2500)


def test_distortion_round_trip(spark):
    cam = Camera(4662.25, 4662.25, 1904.0, 1377.0, (-0.12474347, 0.82940434, -0.01625672, -0.00958748, -1.20843989))
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.uniform(0, 3808), rng.uniform(0, 2754)) for _ in range(20)], "u double, v double")
    x0, y0 = cam.normal(F.col("u"), F.col("v"))
    df = df.select("u", "v", x0.alias("x0"), y0.alias("y0"), x0.alias("x"), y0.alias("y"))
    for _ in range(12):
        x, y = cam.undistort_step(*(F.col(c) for c in ("x0", "y0", "x", "y")))
        df = df.select("u", "v", "x0", "y0", x.alias("x"), y.alias("y"))
    back = df.select("u", "v", *(c.alias(n) for c, n in zip(cam.distort(*cam.pixel(F.col("x"), F.col("y"))), "ab"))).collect()
    assert all(r.u == pytest.approx(r.a, abs=1e-3) and r.v == pytest.approx(r.b, abs=1e-3) for r in back)


def test_replay_by_component_is_the_global_replay(spark):
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 400:
        i, j = sorted(rng.sample(range(12), 2))
        pairs.append((i, rng.randrange(40), j, rng.randrange(40)))
    want = {s: m for s, m in graph.replay(pairs)}
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "ord long, image_i long, kp_i long, image_j long, kp_j long")
    got = {}
    for r in graph.link_chains(df).orderBy("chain", "pos").collect():
        got.setdefault(r.chain, []).append((r.image, r.kp))
    assert got == want


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (20, 20), (8, 30), (30, 31)], "a long, b long")
    got = {r.id: r.component for r in graph.components(e).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 30: 8, 31: 8, 20: 20}


def test_groups_find_two_blocks():
    rng = random.Random(2)
    chains = [sorted(rng.sample(range(8), 4)) for _ in range(300)] + [sorted(rng.sample(range(8, 16), 4)) for _ in range(300)]
    groups, level = graph.grow_groups(chains, 16)
    assert sorted(map(tuple, groups)) == [tuple(range(8)), tuple(range(8, 16))]
    assert set(level) == {0, 1}


def test_nearest_and_within(spark):
    rng = random.Random(1)
    a = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(60)]
    b = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(80)] + [(100, 5.0, 5.0), (101, 5.0, 5.0)]
    da, db = (spark.createDataFrame(x, "id long, x double, y double") for x in (a, b))
    d = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    got = {(r.id, r.rank): r.id_2 for r in nearest(da, db, "id", "id", "x", "y", 4.0, k=3).collect()}
    want = {(p[0], n + 1): q[0] for p in a for n, q in enumerate(sorted(b, key=lambda q: (d(p, q), q[0]))[:3])}
    assert got == want
    pairs = {(r.id, r.id_2) for r in within(da, db, "x", "y", 9.0).collect()}
    assert pairs == {(p[0], q[0]) for p in a for q in b if d(p, q) <= 9.0}


def test_asof_and_interpolation(spark):
    s = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0), ("b", 5.0, 7.0)], "k string, t double, x double")
    q = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 5.0), ("a", 11.0), ("b", 5.0), ("c", 1.0)], "k string, t double")
    at = {(r.k, r.t): r.x_at for r in asof(q, s, "t", ["x"], ["k"]).collect()}
    assert at == {("a", -1.0): None, ("a", 0.0): 1.0, ("a", 5.0): 1.0, ("a", 11.0): 3.0, ("b", 5.0): 7.0, ("c", 1.0): None}
    lerp = {(r.k, r.t): r.x_at for r in interpolate(q, s, "t", "x", ["k"]).collect()}
    assert lerp == {("a", -1.0): 0.0, ("a", 0.0): 1.0, ("a", 5.0): 2.0, ("a", 11.0): 0.0, ("b", 5.0): 7.0, ("c", 1.0): 0.0}


def test_zero_phase_filter_keeps_slow_and_drops_fast():
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 3)
    assert np.abs(series.zero_phase(slow, 0.2) - slow)[30:-30].max() < 0.02
    assert np.abs(series.zero_phase(fast, 0.2))[30:-30].max() < 0.05


def test_bundle_adjustment_recovers_positions():
    rng = np.random.default_rng(4)
    cams = np.array([[x * 20.0, y * 20.0, -100.0] for x in range(3) for y in range(3)])
    points = np.column_stack([rng.uniform(0, 40, 40), rng.uniform(0, 40, 40), rng.uniform(-5, 5, 40)])
    cam, point = (a.ravel() for a in np.meshgrid(range(9), range(40), indexing="ij"))
    rel = points[point] - cams[cam]
    uv = 1000 * rel[:, :2] / rel[:, 2:]
    _, _, err = est.bundle_adjust(cams + rng.normal(0, 1, cams.shape), points + rng.normal(0, 1, points.shape), cam, point, uv, 1000.0, 40)
    assert err < 0.5


def test_dmd_finds_the_rotation():
    k = np.arange(60)
    x = np.array([np.cos(0.3 * k + p) for p in (0, 1, 2)])
    values, _ = est.dmd(x, 2)
    assert np.abs(np.abs(np.angle(values)) - 0.3).max() < 1e-6


def test_triangulation(spark):
    p1 = np.hstack([np.eye(3), np.zeros((3, 1))])
    p2 = np.hstack([np.eye(3), [[-1.0], [0.0], [0.0]]])
    x = np.array([0.3, -0.2, 4.0, 1.0])
    a, b = p1 @ x, p2 @ x
    df = spark.createDataFrame([(1, p1.ravel().tolist(), p2.ravel().tolist(), float(a[0] / a[2]), float(a[1] / a[2]), float(b[0] / b[2]), float(b[1] / b[2]))], "id long, p1 array<double>, p2 array<double>, u1 double, v1 double, u2 double, v2 double")
    r = est.triangulate(df, ["id"]).first()
    assert (r.x, r.y, r.z) == pytest.approx((0.3, -0.2, 4.0))


def test_ray_intersection_meets_in_a_point(spark):
    rows = [("a", 0.0, 0.0, 0.0, 1.0, 2.0, 3.0), ("a", 5.0, 0.0, 0.0, -4.0, 2.0, 3.0), ("a", 0.0, 7.0, 1.0, 1.0, -5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, px double, py double, pz double, vx double, vy double, vz double")
    r = est.ray_intersection(df, "g").first()
    assert (r.x, r.y, r.z) == pytest.approx((1, 2, 3))


def test_coordinate_search():
    best = est.coordinate_search(lambda pts: [(p[0] - 1.5) ** 2 + (p[1] + 2) ** 2 for p in pts], [0.0, 0.0], 4.0)
    assert best == pytest.approx([1.5, -2.0], abs=1e-2)


def test_hull_and_terrain(spark):
    pts = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (2.0, 1.0), (4.0, 1.0)]
    df = spark.createDataFrame([("g", *p) for p in pts], "g string, x double, y double")
    got = [(r.x, r.y) for r in sinks.hulls(df, "g", "x", "y").orderBy("pos").collect()]
    assert got == [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    raw = np.array([[1, 2], [40000, 65535]], dtype=">u2").tobytes()
    assert terrain.unpack(raw).tolist() == [[1, 2], [0, 0]]
    name = one(spark, terrain.tile_name(F.lit(5.5), F.lit(-93.2)))[0]
    assert name == "N05W094"


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, x double, y double")
    assert nearest(e, e, "id", "id", "x", "y", 1.0).count() == 0
    assert graph.components(e.select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_fill_along_ranges_without_known_values(spark):
    rows = [(k, float(k * k) if k in (40, 41, 90, 300) else None) for k in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0)], "i int, v double")
    known = [k for k, v in rows if v is not None]
    got = {r.i: r.v_at for r in series.fill_along(df, "i", "v").collect()}
    want = np.interp(range(400), known, [k * k for k in known])
    assert len(got) == 400 and all(abs(got[k] - want[k]) < 1e-9 for k in range(400))
    assert {r.v_at for r in series.fill_along(df.filter("v is null"), "i", "v").collect()} == {0.0}


def test_groups_of_parts_are_those_of_one_growth(spark):
    """Parts are replayed apart, each from four-byte numbers; the first group of fewer than three images still ends all."""
    r = random.Random(4)
    for parts, few in ((3, False), (4, True)):
        chains = [(c, [10 * k + i for i in sorted(r.sample(range(10), r.randrange(3, 7)))]) for k in range(parts) for c in range(k, 400, parts)]
        if few:
            chains.append((1000, [50, 51, 52, 53]))
        rows = [(c, p, i) for c, m in chains for p, i in enumerate(m)]
        got = {(x.group_id, x.image) for x in graph.image_groups(spark.createDataFrame(rows, "chain long, pos int, image long"), 60, 8).collect()}
        ordered = [m for _, m in sorted(chains, key=lambda x: (-len(x[1]), x[0]))]
        groups, _ = graph.grow_groups(ordered, 60, 8)
        assert got == {(k, i) for k, g in enumerate(groups) for i in g} and got
        assert {x.part for x in graph.parts(spark.createDataFrame(rows, "chain long, pos int, image long")).collect()} >= {0, 10, 20}


def swept(chains, images, wanted, least, smallest, min_chain):
    """The reference's loop: all chains are asked in each sweep, until one adds nothing."""
    level, placed, groups = [-1] * len(chains), set(), []
    while True:
        free = [k for k, c in enumerate(chains) if level[k] < 0 and len(c) > 2 and not placed & set(c)]
        if not free:
            return groups, level
        have, todo, start = [0] * images, [max(free, key=lambda k: len(chains[k]))], None
        while todo:
            if start is None:
                start = chains[todo[0]][1]
            else:
                todo = range(len(chains))
            busy = False
            for k in todo:
                open_ = [i for i in chains[k] if i not in placed]
                tied = start in open_ or sum(have[i] >= min(least, wanted) for i in open_) > (min_chain > 2)
                if level[k] < 0 and (min_chain == 2 or len(chains[k]) > 2) and tied and any(have[i] < wanted for i in open_):
                    for i in chains[k]:
                        have[i] += 1
                    level[k], busy = len(groups), True
            todo = busy
        mine = [i for i in range(images) if have[i] >= least]
        placed |= set(mine)
        groups += [mine] * (len(mine) >= smallest)
        if len(mine) < 3:
            return groups, level


def test_groups_are_those_of_whole_sweeps(monkeypatch):
    """Chains are asked once a group and not in each sweep: the same groups and levels, also where a chain holds an image twice."""
    r, several = random.Random(7), 0
    for k in range(300):
        images, wanted, least, width = r.randrange(4, 50), r.choice([2, 3, 6, 30]), r.choice([1, 2, 3, 8]), r.choice([3, 6, 12])
        near = [[(low + r.randrange(width)) % images for _ in range(r.randrange(1, 8))] for low in (r.randrange(images) for _ in range(r.randrange(200)))]
        chains = sorted(near if k % 3 == 0 else map(lambda c: list(dict.fromkeys(c)), near), key=lambda c: -len(c))
        monkeypatch.setattr(graph, "most_wanted", lambda _, w=wanted: w)
        for min_chain in (2, 3):
            got = graph.grow_groups(chains, images, least, 4, min_chain)
            assert got == swept(chains, images, wanted, least, 4, min_chain)
            several += len(got[0]) > 1
    assert several > 20


def test_chains_of_images_step_by_step():
    r = np.random.default_rng(3)
    for step in (8, 30, 1000):
        sizes = r.integers(0, 5, 200)
        starts, flat = np.r_[0, np.cumsum(sizes)], r.integers(0, 7, sizes.sum()).astype(np.int32)
        begins, chains = graph.chains_of_images(starts, flat, 7, step)
        owner = np.repeat(np.arange(200), sizes)
        assert all(chains[begins[i] : begins[i + 1]].tolist() == owner[flat == i].tolist() for i in range(7))


def test_groups_of_one_large_part_stay_out_of_memory(spark, tmp_path, monkeypatch):
    """Python's peak in the task that replays a part: 300,000 observations took 36 MB, they are in mapped files now."""
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame

    real, at = DataFrame.mapInArrow, str(tmp_path)

    def watched(df, f, *args, **more):
        def run(batches):
            import os
            import tracemalloc
            import uuid

            import pyarrow  # noqa: F401

            tracemalloc.start()
            yield from f(batches)
            with open(os.path.join(at, uuid.uuid4().hex), "w") as out:
                out.write(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

        return real(df, run, *args, **more)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    i = F.col("id")
    o = spark.range(300_000).select(F.floor(i / 30).alias("chain"), (i % 30).cast("int").alias("pos"), ((F.floor(i / 30) * 7 + i % 30) % 1000).alias("image"))
    assert graph.image_groups(o, 1000).select("image").distinct().count() > 900
    peaks = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert peaks and max(peaks) < 6e6, peaks

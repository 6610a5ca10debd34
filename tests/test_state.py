"""Saved state, sensor logs, image metadata and the matcher."""

import numpy as np

from skyloom.operators.grids import fill_bins, ray_surface
from skyloom.operators.matching import two_nearest
from skyloom.sources import flight, sinks, state


def test_state_round_trip_and_repair(spark, tmp_path):
    f = spark.createDataFrame([("a", k, 1.0 * k, 2.0) for k in range(300)], "image string, kp int, u double, v double")
    c = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 5), (2, 0, "a", 999)], "chain long, pos int, image string, kp int")
    for kind, df in (("features", f), ("chains", c)):
        state.write_state(df, str(tmp_path / kind), kind)
    f, c = (state.read_state(spark, str(tmp_path / k), k) for k in ("features", "chains"))
    assert f.count() == 300 and f.first().size is None and c.columns[:4] == ["chain", "pos", "image", "kp"]
    assert state.with_images(c, spark.createDataFrame([("a",)], "name string")).count() == 2
    assert {(r.image, r.kp) for r in state.dangling(c, f).collect()} == {("b", 5), ("a", 999)}
    some, kept = state.feature_sample(f, c, 0.5)
    n = some.count()
    assert 100 < n < 200 and sorted(r.kp for r in some.collect()) == list(range(n))
    old = {r.u: r.kp for r in some.collect()}
    assert [r.kp for r in kept.collect()] == ([old[5.0]] if 5.0 in old else [])


def test_sensor_logs(spark, tmp_path):
    (tmp_path / "imu.csv").write_text("Timestamp, P (rad/sec), Q (rad/sec)\n1.0, 0.1, x\n,1,1\n2.5, 0.2, 0.3\n")
    imu = flight.read_flight_log(spark, str(tmp_path), ("imu",))["imu"]
    assert [tuple(r) for r in imu.orderBy("time").collect()] == [(1.0, 0.1, None), (2.5, 0.2, 0.3)] and imu.columns == ["time", "p", "q"]
    (tmp_path / "h.csv").write_text("video frame,video time,camera roll (deg),camera pitch (deg)\n1,0.0,1.0,2.0\n2,0.5,2.0,2.0\n3,0.5,9.0,1.0\n")
    assert [(r.roll_rate, r.pitch_rate) for r in flight.read_horizon(spark, str(tmp_path / "h.csv")).orderBy("frame").collect()] == [(0.0, 0.0), (2.0, 0.0), (0.0, 0.0)]


def test_poses_of_image_packets(spark, tmp_path):
    packet = '<x:xmpmeta><rdf drone:GpsLatitude="+45.5" drone:GpsLongtitude="-93.25" drone:AbsoluteAltitude="+310.1" drone:GimbalYawDegree="12.5" drone:FlightYawDegree="1" tiff:Make="DJI" tiff:Model="FC"><drone:FlightPitchDegree>-3</drone:FlightPitchDegree></rdf></x:xmpmeta>'
    (tmp_path / "b.JPG").write_bytes(b"\xff\xd8\xff" + packet.encode() + b"\x00\xff")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8")
    p = flight.read_xmp_pose(spark, str(tmp_path))
    rows = {r.name: r for r in p.collect()}
    b = rows["b.JPG"]
    assert (b.lat_deg, b.lon_deg, b.alt_m, b.yaw_deg, b.pitch_deg, b.roll_deg, b.make) == (45.5, -93.25, 310.1, 12.5, -3.0, None, "DJI")
    assert rows["c.jpg"].lat_deg is None and flight.camera_of(p).first().camera == "DJI_FC"


def test_two_nearest_in_tiles(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(k % 2, k, v[k].tolist()) for k in range(60)] + [(7, 99, v[0].tolist())], "g int, id long, vec array<double>")
    got = {(r.i, r.rn): r.j for r in two_nearest(df, df, "g", tile=7, apart=True).collect()}
    for i in range(60):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[[j for j in range(60) if j == i or j % 2 != i % 2]] = np.inf
        assert [got[i, 1], got[i, 2]] == np.argsort(d)[:2].tolist()
    assert (99, 1) not in got


def test_rays_against_a_plain_loop(spark):
    z = {(i, j): 5.0 * np.sin(i) + 4.0 * np.cos(2 * j) for i in range(12) for j in range(12)}
    grid = spark.createDataFrame([(i, j, float(h)) for (i, j), h in z.items()], "i long, j long, z double")
    rays = [(k, 30.0 + 7 * k, 35.0 + 5 * k, -60.0, 0.9, 0.2 * (k % 3), 1.0 if k != 4 else -1.0) for k in range(8)]
    got = {r.k: (r.x, r.y, r.z) for r in ray_surface(spark.createDataFrame(rays, "k int, n double, e double, d double, vn double, ve double, vd double"), grid, 10.0).collect()}

    def height(x, y):
        i, j = int(np.floor(x / 10)), int(np.floor(y / 10))
        a, b = x / 10 - i, y / 10 - j
        total = 0.0
        for di, dj, w in ((0, 0, (1 - a) * (1 - b)), (1, 0, a * (1 - b)), (0, 1, (1 - a) * b), (1, 1, a * b)):
            if w:
                if (i + di, j + dj) not in z:
                    return None
                total += w * z[i + di, j + dj]
        return total

    for k, n, e, d, vn, ve, vd in rays:
        p, ground = (n, e, d), height(n, e) or 0.0
        steps = 0
        while vd > 0 and abs(p[2] + ground) > 0.01 and steps < 25:
            down = -(d + ground)
            p = (n + vn * down / vd, e + ve * down / vd, d + down)
            h = height(p[0], p[1])
            ground = ground if h is None else h
            steps += 1
        assert np.allclose(got[k], p, atol=1e-9)


def test_bins_are_filled_until_none_is_left(spark):
    one = spark.createDataFrame([(0, 0, 3.0, 4), (5, 5, 9.0, 2)], "cx long, cy long, mean double, n long")
    full = {(r.cx, r.cy): r.mean for r in fill_bins(one, 6, 6).collect()}
    assert len(full) == 36 and full[0, 1] == 3.0 and full[5, 4] == 9.0 and 3.0 < full[2, 3] < 9.0
    assert fill_bins(one.limit(0), 6, 6).count() == 0


def test_text_sinks(spark, tmp_path):
    lines = lambda name: [r.value for r in spark.read.text(str(tmp_path / name)).collect()]
    sinks.write_clusters(spark.createDataFrame([(1.5, 2.5, 3), (4.0, 5.0, 9)], "lat_deg double, lon_deg double, cnt long").coalesce(1), str(tmp_path / "c"))
    assert [x for x in lines("c") if not x.startswith("lat")] == ["4.0000000,5.0000000,9", "1.5000000,2.5000000,3"]
    sinks.write_tile_manifest(spark.createDataFrame([("a.b.jpg", 0, 1), ("plain", 1, 0)], "image string, i int, j int"), str(tmp_path / "t"))
    assert sorted(x for x in lines("t") if not x.startswith("tile")) == ["a.b_01.jpg,a.b.jpg", "plain_10,plain"]
    sinks.write_points(spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, None, 1.0)], "x double, y double, z double"), str(tmp_path / "p"))
    assert lines("p") == ["1.0000 2.0000 3.0000"]
    sinks.write_frames(spark.createDataFrame([(2, 0.5), (1, 0.25)], "frame int, time double").coalesce(1), str(tmp_path / "f"))
    assert [x for x in lines("f") if not x.startswith("frame")] == ["1,0.250000", "2,0.500000"]
    at = spark.createDataFrame([(1.0, 2.0), (3.0, -4.0)], "lat_deg double, lon_deg double")
    assert 'data-images="2" data-bounds="[[1.0000000,-4.0000000],[3.0000000,2.0000000]]"' in sinks.map_page(at, "a < b").first().value
    assert sinks.map_page(at.limit(0), "x").first().value is None
    v = spark.createDataFrame([("o", k, 1.0 * k, 0.0, 0.0) for k in range(3)], "object string, v int, x double, y double, z double")
    text = sinks.triangle_mesh(v, spark.createDataFrame([("o", 0, 1, 2)], "object string, a int, b int, c int")).first().text
    assert text.startswith('OBJECT poly\nname "o"\nnumvert 3\n0.0 0.0 0.0\n') and text.endswith("refs 3\n0 0 0\n1 0 0\n2 0 0\nkids 0")

"""Readers and writers on small files."""

import gzip
import json

import numpy as np
import pytest

from skyloom.sources import flight, sinks, survey, terrain


def test_poses(spark, tmp_path):
    for n in ("b.JPG", "a.jpg", "c.jpg", "x.txt"):
        (tmp_path / n).write_bytes(b"x")
    images = survey.list_images(spark, str(tmp_path))
    assert [(r.name, r.idx) for r in images.orderBy("idx").collect()] == [("a.jpg", 0), ("b.JPG", 1), ("c.jpg", 2)]
    (tmp_path / "p.csv").write_text("File,Lat,Lon\n# note\na.jpg,45.0,-93.0,200,1,2,3\nzz.jpg,45,-93,200,1,2,3,9.5\n")
    p = survey.read_poses(spark, str(tmp_path / "p.csv"))
    r = survey.poses_by_name(p, images).collect()
    assert [(x.name, x.roll_deg, x.pitch_deg, x.yaw_deg, x.flight_time) for x in r] == [("a.jpg", 1.0, 2.0, 3.0, None)]
    (tmp_path / "q.txt").write_text("Image,Lat\n2,45.0,-93.0,200,3,2,1\n")
    r = survey.poses_by_name(survey.read_poses(spark, str(tmp_path / "q.txt"), "ypr"), images).collect()
    assert [(x.name, x.roll_deg, x.yaw_deg) for x in r] == [("b.JPG", 1.0, 3.0)]


def test_meta_camera_groups(spark, tmp_path):
    pose = {"ned": [1, 2, 3], "yaw_deg": 1, "pitch_deg": 2, "roll_deg": 3, "quat": [1, 0, 0, 0]}
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/b.json").write_text(json.dumps({"name": "b", "camera_pose": pose}, indent=1))
    (tmp_path / "meta/a.json").write_text(json.dumps({"name": "a", "camera_pose": pose, "camera_pose_opt": pose | {"valid": True, "ned": [9, 9, 9]}}))
    m = survey.pose_of(survey.read_image_meta(spark, str(tmp_path / "meta")))
    assert [(r.name, r.idx, r.pose.ned) for r in m.orderBy("idx").collect()] == [("a", 0, [9.0, 9.0, 9.0]), ("b", 1, [1.0, 2.0, 3.0])]
    (tmp_path / "c1.json").write_text(json.dumps({"make": "X", "K": [1.0], "width_px": 10}))
    (tmp_path / "c2.json").write_text(json.dumps({"make": "Y"}))
    c = survey.read_camera(spark, str(tmp_path / "c1.json"), str(tmp_path / "c2.json")).first()
    assert (c.make, c.K_opt, c.width_px) == ("Y", [1.0], 10)
    g = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c")], "group_id int, image string")
    sinks.write_groups(g, str(tmp_path / "g"))
    assert sorted(map(tuple, survey.read_groups(spark, str(tmp_path / "g")).collect())) == [(0, "a"), (0, "b"), (1, "c")]
    (tmp_path / "bad.json").write_text("{nope")
    assert survey.read_groups(spark, str(tmp_path / "bad.json")).count() == 0


@pytest.mark.parametrize("text", [
    '{"id_prefix": "m", "markers": [{"id": 4, "lat_deg": 1.5, "lon_deg": 2.5, "alt_m": 3, "comment": "c"}]}',
    '[{"id": 4, "lat_deg": 1.5, "lon_deg": 2.5, "alt_m": 3, "comment": "c"}]',
    '[[1.5, 2.5, 3.0, "c"]]',
])
def test_annotation_shapes(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    r = survey.read_annotations(spark, str(tmp_path / "a.json")).first()
    assert (r.lat_deg, r.lon_deg, r.alt_m, r.comment) == (1.5, 2.5, 3.0, "c") and r.id in (4, 0)


def test_annotation_csv_and_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("OBJECTID,My Latitude,the LONGITUDE\n3,1.5,2.5\n")
    assert tuple(survey.read_annotation_csv(spark, str(tmp_path / "a.csv")).first()) == (3, 1.5, 2.5, 0.0)
    sets = spark.createDataFrame([(1, "/p")], "subject_set_id int, project_path string")
    subjects = spark.createDataFrame([(7, 1, '{"filename": "f.jpg"}'), (8, 2, "{}")], "subject_id long, subject_set_id int, metadata string")
    marks = '[{"value": [{"x": 1, "y": 2, "details": [{"value": "v"}]}, {"x": 3, "y": 4, "tool": 1}, {"x": 5, "y": 6, "tool": 1, "r": 9}]}]'
    cls = spark.createDataFrame([(7, '{"subject_dimensions": [{"w": 1}]}', marks), (7, '{"subject_dimensions": [null]}', marks), (8, '{"subject_dimensions": [{}]}', marks)], "subject_ids long, metadata string, annotations string")
    got = sorted((r.x, r.y, r.r, r.value) for r in survey.crowd_labels(sets, subjects, cls).collect())
    assert got == [(1.0, 2.0, None, "v"), (5.0, 6.0, 9.0, None)]


def test_flight_files(spark, tmp_path):
    (tmp_path / "log_2020-05-06.csv").write_text(
        "CUSTOM.updateTime [local], OSD.latitude, OSD.longitude, OSD.altitude [ft], GIMBAL.pitch, GIMBAL.roll, GIMBAL.yaw\n"
        "12:00:01.5 PM,45,-93,100,-90,0,1\n12:00:02 AM,45,-93,100,-90,0,1\n1:00:00 PM,0,0,1,1,1,1\n"
    )
    t = [r.time for r in flight.read_drone_csv(spark, str(tmp_path / "log_2020-05-06.csv")).collect()]
    assert t == [1588766401.5, 1588723202.0]
    (tmp_path / "s.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\nGPS (-93.1, 45.2, 210.0) x\n\n2\n00:01:00,000 --> 00:01:01,000\n<font>\nlatitude : 45.5 longtitude : n/a altitude: 3\n")
    r = flight.read_srt(spark, str(tmp_path / "s.srt")).orderBy("counter").collect()
    assert [(x.time, x.lat, x.lon, x.alt) for x in r] == [(1.5, 45.2, -93.1, 210.0), (60.0, 45.5, None, 3.0)]
    (tmp_path / "e.txt").write_text("time roll pitch\n1.0 0.01 0.5\n2.0,0.02,-0.03\n")
    assert [tuple(x) for x in flight.read_corrections(spark, str(tmp_path / "e.txt")).orderBy("time").collect()] == [(1.0, 0.01, 0.0), (2.0, 0.02, -0.03)]
    rows = "1 100 0 0 KABC Name\n100 a b c d e f g h 45.0 -93.0 i j k l m n o 45.2 -93.2\n1 50 0 0 KNONE X\n"
    with gzip.open(tmp_path / "apt.dat.gz", "wt") as f:
        f.write(rows)
    a = flight.runways(flight.numbered_lines(spark, str(tmp_path / "apt.dat.gz"))).collect()
    assert [(x.ident, round(x.lat, 6), round(x.lon, 6)) for x in a] == [("KABC", 45.1, -93.1)]
    log = spark.createDataFrame([(1, 0.0, "camera"), (1, 1.0, "gate on"), (1, 2.0, "camera"), (1, 5.0, "camera"), (1, 6.0, "gate off"), (1, 7.0, "camera")], "flight int, time double, message string")
    assert [(x.time, x.interval) for x in flight.triggers(log).orderBy("time").collect()] == [(2.0, 0.0), (5.0, 3.0)]


def test_terrain_files(spark, tmp_path):
    (tmp_path / "N45W094.hgt").write_bytes(np.arange(9, dtype=">u2").tobytes())
    got = {(r.row, r.col): r.z for r in terrain.read_tiles(spark, str(tmp_path)).collect()}
    assert got == {(i, j): 3 * i + j for i in range(3) for j in range(3)}
    (tmp_path / "North").write_text("N45W094.hgt.zip\n\n")
    assert [tuple(r) for r in terrain.read_catalog(spark, str(tmp_path / "North")).collect()] == [("N45W094", "North")]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)], "name string, lat_deg double, lon_deg double, alt_m double, roll_deg double, pitch_deg double, yaw_deg double, flight_time double")
    sinks.write_pose_csv(p, str(tmp_path / "pix"))
    assert spark.read.text(str(tmp_path / "pix")).filter("value like 'a,%'").first()[0] == "a,1.0000000000,2.0000000000,3.00,4.00,5.00,6.00,7.00"
    with pytest.raises(Exception):
        sinks.write_pose_csv(p, str(tmp_path / "pix"))
    v = spark.createDataFrame([("i", i, j, 0.0, 0.0, float("nan") if (i, j) == (2, 2) else 1.0) for i in range(3) for j in range(3)], "image string, i int, j int, x double, y double, z double")
    assert sinks.mesh_quads(v, 2).first().text.count("f ") == 3
    m = spark.createDataFrame([("p", 1, 1.0, 2.0, 3.0, "c")], "id_prefix string, id int, lat_deg double, lon_deg double, alt_m double, comment string")
    assert json.loads(sinks.annotation_json(m).first()[0])["markers"][0]["comment"] == "c"


def test_metadata_and_configuration_come_back(spark, tmp_path):
    rows = [(f"img{k}", 45.0 + k, None if k == 2 else -93.0) for k in range(7)]
    df = spark.createDataFrame(rows, "name string, lat_deg double, lon_deg double")
    for _ in range(2):  # an older target is replaced
        sinks.write_image_meta(df.coalesce(2), str(tmp_path / "meta"))
    files = [f for f in (tmp_path / "meta").iterdir() if f.name.endswith(".json")]
    assert len(files) == 7 and all(f.read_text().count("\n") == 1 for f in files)
    back = spark.read.schema(df.schema).option("multiLine", True).json(str(tmp_path / "meta"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert [r.idx for r in survey.read_image_meta(spark, str(tmp_path / "meta")).orderBy("name").collect()] == list(range(7))
    sinks.write_config(spark.createDataFrame([([1.0, 2.0],)], "K array<double>"), str(tmp_path / "config"))
    assert survey.read_camera(spark, str(tmp_path / "config")).first().K_opt == [1.0, 2.0]
    with pytest.raises(ValueError):
        sinks.write_config(df, str(tmp_path / "config"))

"""EXIF files of both byte orders, made here byte by byte, and files that are broken."""

import struct

import pytest

from skyloom.sources.exif import first_camera, read_exif, read_image_poses, read_tags

PACKET = b'<x:xmpmeta\n drone-dji:GimbalYawDegree="-30.5"\n drone-dji:GpsLatitude="46.5"\n drone-dji:GimbalPitchDegree="-90.0"\n></x:xmpmeta>'


def tiff(order, tags):
    """A TIFF with directories {number: {tag: (type, values)}}; 0 is the main one, which points to the others."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4)

    def put(entries):
        packed = []
        for tag, (kind, values) in sorted(entries.items()):
            raw = values if kind == 2 else b"".join(struct.pack(order + {3: "H", 4: "I", 5: "II"}[kind], *(v if kind == 5 else (v,))) for v in values)
            count = len(values)
            if len(raw) > 4:
                where = len(out)
                out.extend(raw)
                raw = struct.pack(order + "I", where)
            packed.append(struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0"))
        at = len(out)
        out.extend(struct.pack(order + "H", len(packed)) + b"".join(packed) + b"\0" * 4)
        return at

    main = dict(tags[0])
    for pointer in (0x8769, 0x8825):
        if pointer in tags:
            main[pointer] = (4, [put(tags[pointer])])
    out[4:8] = struct.pack(order + "I", put(main))
    return bytes(out)


def jpeg(body, after=b""):
    extra = struct.pack(">BBH", 0xFF, 0xE0, 16) + b"JFIF\0" + b"\0" * 9
    return b"\xff\xd8" + extra + struct.pack(">BBH", 0xFF, 0xE1, len(body) + 8) + b"Exif\0\0" + body + after + b"\xff\xda\0\0picture"


TAGS = {
    0: {0x010F: (2, b"DJI\0"), 0x0110: (2, b"FC 300/S\0\0"), 0x0132: (2, b"2024:03:05 06:07:08\0")},
    0x8769: {0xA434: (2, b"Lens 24\0")},
    0x8825: {1: (2, b"S\0"), 2: (5, [(10, 1), (30, 1), (3600, 100)]), 3: (2, b"E\0"), 4: (5, [(20, 1), (0, 1), (0, 1)]), 6: (5, [(12345, 100)])},
}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("wrap", [jpeg, bytes])
def test_both_byte_orders(order, wrap):
    got = read_tags(wrap(tiff(order, TAGS)))
    assert got == ("DJI", "FC 300/S", "Lens 24", pytest.approx(-10.51), 20.0, 123.45, "2024:03:05 06:07:08")


def test_broken_bytes_give_nulls_and_never_fail():
    whole = jpeg(tiff("<", TAGS))
    for cut in range(0, len(whole), 3):
        assert len(read_tags(whole[:cut])) == 7
    for k in range(0, len(whole), 2):
        assert len(read_tags(whole[:k] + b"\xff" + whole[k + 1 :])) == 7
    assert read_tags(b"") == read_tags(b"\xff\xd8\xff\xe1\0\0") == (None,) * 7
    zero = {0: {}, 0x8825: {1: (2, b"N\0"), 2: (5, [(1, 0), (0, 1), (0, 1)])}}
    assert read_tags(tiff(">", zero))[3] is None


def test_folder_of_images(spark, tmp_path):
    (tmp_path / "b.JPG").write_bytes(jpeg(tiff(">", TAGS), PACKET))
    (tmp_path / "c.tif").write_bytes(tiff("<", {0: TAGS[0]}))
    (tmp_path / "a.jpg").write_bytes(b"no image")
    (tmp_path / "d.txt").write_bytes(b"other")
    rows = {r.name: r for r in read_exif(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.jpg", "b.JPG", "c.tif"}
    assert rows["b.JPG"].camera == "DJI_FC_300-S_Lens_24" and rows["b.JPG"].unix_time == 1709618828.0
    assert rows["c.tif"].camera == "DJI_FC_300-S" and rows["c.tif"].lat_deg is None and rows["a.jpg"].camera is None
    assert tuple(first_camera(read_exif(spark, str(tmp_path))).first()) == ("DJI_FC_300-S_Lens_24", "DJI", "FC 300/S", "Lens 24")
    pose = {r.name: r for r in read_image_poses(spark, str(tmp_path)).collect()}["b.JPG"]
    assert (pose.lat_deg, pose.lon_deg, pose.alt_m, pose.yaw_deg, pose.pitch_deg, pose.roll_deg) == (46.5, 20.0, 123.45, 329.5, -90.0, None)

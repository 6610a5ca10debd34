"""Camera, position and time from the EXIF part of image files (S02-S04), and joined with their XMP packets.

Files come through Spark's binary reader, so partitions are planned by Spark and any store that it
reads will do; a task walks the TIFF directories of one file after another and leaves one short row.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flight import read_xmp_pose

#: Fixed values of the TIFF and EXIF formats: bytes of a value by type; tags of the directories.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
MAKE, MODEL, TIME, EXIF, GPS, LENS = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825, 0xA434
LAT_REF, LAT, LON_REF, LON, ALT = 1, 2, 3, 4, 6


def tiff_part(data: bytes) -> bytes:
    """The TIFF bytes: a whole TIFF file, or the EXIF segment of a JPEG file; empty where there are none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2:  # the picture begins
            break
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def directory(tiff: bytes, at: int) -> dict[int, object]:
    """Tags of the directory at a place: text, or a list of numbers; entries that point outside are left out."""
    order, out = "<" if tiff[:2] == b"II" else ">", {}
    if at <= 0 or at + 2 > len(tiff):
        return out
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
        size = SIZES.get(kind, 0) * count
        place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
        if not size or place + size > len(tiff):
            continue
        raw = tiff[place : place + size]
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            pairs = struct.iter_unpack(order + ("II" if kind == 5 else "ii"), raw)
            out[tag] = [a / b if b else None for a, b in pairs]
        elif kind in (3, 4, 9):
            out[tag] = [x for (x,) in struct.iter_unpack(order + {3: "H", 4: "I", 9: "i"}[kind], raw)]
        else:
            out[tag] = list(raw)
    return out


def degrees(parts, sign) -> float | None:
    """Degrees, minutes and seconds as one number, negative in the south and west."""
    if not isinstance(parts, list) or len(parts) != 3 or None in parts:
        return None
    return (-1 if str(sign)[:1].upper() in ("S", "W") else 1) * (parts[0] + parts[1] / 60 + parts[2] / 3600)


def read_tags(data: bytes) -> tuple:
    """(make, model, lens_model, lat_deg, lon_deg, alt_m, taken) of one file; what is missing or broken is null."""
    tiff = tiff_part(data)
    if len(tiff) < 8:
        return (None,) * 7
    order = "<" if tiff[:2] == b"II" else ">"
    main = directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0])
    below = [directory(tiff, main[t][0]) if isinstance(main.get(t), list) else {} for t in (EXIF, GPS)]
    text = lambda d, t: d[t] if isinstance(d.get(t), str) and d[t] else None
    gps = below[1]
    high = gps.get(ALT)
    return (
        text(main, MAKE), text(main, MODEL), text(below[0], LENS), degrees(gps.get(LAT), gps.get(LAT_REF)), degrees(gps.get(LON), gps.get(LON_REF)),
        high[0] if isinstance(high, list) and high else None, text(main, TIME),
    )


def read_exif(spark: SparkSession, folder: str) -> DataFrame:
    """(name, make, model, lens_model, camera, lat_deg, lon_deg, alt_m, unix_time) of the jpg and tif files of a folder.

    ``camera`` joins make, model and lens with underscores for spaces and dashes for slashes, null without a make and a model.
    ``unix_time`` reads the time as UTC. The altitude is the number as it stands, whatever its
    reference. Files without EXIF, and tags that are missing or broken, give nulls.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,JPG,tif,TIF}").load(folder)
    names = ("make", "model", "lens_model", "lat_deg", "lon_deg", "alt_m", "taken")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [read_tags(c.as_buffer().to_pybytes()) for c in batch.column(1)]
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.string()] * 3 + [pa.float64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, kinds))], ["name", *names])

    found = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").mapInArrow(run, "name string, make string, model string, lens_model string, lat_deg double, lon_deg double, alt_m double, taken string")
    camera = F.when(F.col("make").isNotNull() | F.col("model").isNotNull(), F.translate(F.concat_ws("_", "make", "model", "lens_model"), " /", "_-"))
    time = F.unix_timestamp(F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double")
    return found.select("name", "make", "model", "lens_model", camera.alias("camera"), "lat_deg", "lon_deg", "alt_m", time.alias("unix_time"))


def first_camera(exif: DataFrame) -> DataFrame:
    """(camera, make, model, lens_model) of the first image by name that tells its camera."""
    known = exif.filter(F.col("camera").isNotNull())
    return known.agg(F.min_by(F.struct("camera", "make", "model", "lens_model"), "name").alias("c")).select("c.*").filter(F.col("camera").isNotNull())


def read_image_poses(spark: SparkSession, folder: str) -> DataFrame:
    """(name, lon_deg, lat_deg, alt_m, unix_time, yaw_deg, pitch_deg, roll_deg, camera): the XMP packet's values, else those of EXIF; yaw from 0 to 360."""
    xmp = read_xmp_pose(spark, folder).select("name", *(F.col(c).alias(f"x_{c}") for c in ("lat_deg", "lon_deg", "alt_m")), F.pmod("yaw_deg", F.lit(360.0)).alias("yaw_deg"), "pitch_deg", "roll_deg")
    both = read_exif(spark, folder).join(xmp, "name", "left")
    place = [F.coalesce(f"x_{c}", c).alias(c) for c in ("lon_deg", "lat_deg", "alt_m")]
    return both.select("name", *place, "unix_time", "yaw_deg", "pitch_deg", "roll_deg", "camera")

"""Readers of survey projects: image lists, poses, metadata, chains, groups, annotations, crowd labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ranked

IMAGE_META = (
    "name string, width int, height int, flight_time double, "
    "aircraft_pose struct<lat_deg:double,lon_deg:double,alt_m:double,yaw_deg:double,pitch_deg:double,roll_deg:double,yaw_error_deg:double,quat:array<double>>, "
    "camera_pose struct<ned:array<double>,yaw_deg:double,pitch_deg:double,roll_deg:double,quat:array<double>>, "
    "camera_pose_opt struct<valid:boolean,ned:array<double>,yaw_deg:double,pitch_deg:double,roll_deg:double,quat:array<double>>"
)
CAMERA = (
    "make string, model string, lens_model string, K array<double>, dist_coeffs array<double>, K_opt array<double>, dist_coeffs_opt array<double>, "
    "focal_len_mm double, ccd_width_mm double, ccd_height_mm double, width_px int, height_px int, mount struct<yaw_deg:double,pitch_deg:double,roll_deg:double>"
)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, idx) of the folder's jpg files, sorted by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP][gG]").load(folder)
    names = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return ranked(names, ["name"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def read_poses(spark: SparkSession, path: str, order: str = "rpy") -> DataFrame:
    """(key, by_index, lat_deg, lon_deg, alt_m, roll_deg, pitch_deg, yaw_deg, flight_time) of pose rows.

    Comments and header rows (File..., Image...) go; after an Image header the key is the
    image's 1-based index instead of its name. order: ``rpy`` or ``ypr``.
    """
    lines = spark.read.text(path)
    indexed = lines.filter(F.col("value").startswith("Image")).limit(1).count() > 0
    p = F.split("value", r"\s*,\s*")
    rows = lines.filter(~F.col("value").rlike(r"^\s*(#|File|Image|$)")).select(p.alias("p"))
    angle = dict(zip(order, range(4, 7)))
    num = lambda k: F.get("p", F.lit(k)).try_cast("double")
    return rows.select(
        F.col("p")[0].alias("key"), F.lit(indexed).alias("by_index"), num(1).alias("lat_deg"), num(2).alias("lon_deg"), num(3).alias("alt_m"),
        num(angle["r"]).alias("roll_deg"), num(angle["p"]).alias("pitch_deg"), num(angle["y"]).alias("yaw_deg"), num(7).alias("flight_time"),
    )


def poses_by_name(poses: DataFrame, images: DataFrame) -> DataFrame:
    """Poses whose image exists, with its name; keys that are indices meet the sorted names by position."""
    by_name = poses.filter("not by_index").join(images.select(F.col("name").alias("key")), "key", "left_semi").withColumnRenamed("key", "name")
    at = images.select((F.col("idx") + 1).cast("string").alias("key"), "name")
    by_index = poses.filter("by_index").join(at, "key").select("name", *(c for c in poses.columns if c != "key"))
    return by_name.unionByName(by_index).drop("by_index")


def read_image_meta(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata of JSON files under a fixed schema; the index is the position by name."""
    df = spark.read.schema(IMAGE_META).option("multiLine", True).json(path)
    return ranked(df, ["name"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def pose_of(df: DataFrame, optimized: bool = True) -> DataFrame:
    """``df`` with ``pose``: the optimized camera pose where it is valid, else the direct one."""
    direct = F.col("camera_pose")
    fields = ("ned", "yaw_deg", "pitch_deg", "roll_deg", "quat")
    opt = F.struct(*(F.col(f"camera_pose_opt.{f}").alias(f) for f in fields))
    return df.withColumn("pose", F.when(F.lit(optimized) & F.coalesce(F.col("camera_pose_opt.valid"), F.lit(False)), opt).otherwise(direct))


def read_camera(spark: SparkSession, path: str, over: str | None = None) -> DataFrame:
    """One camera configuration; fields of a second file win, and optimized arrays fall back to the plain ones."""
    df = spark.read.schema(CAMERA).option("multiLine", True).json(path)
    if over:
        top = spark.read.schema(CAMERA).option("multiLine", True).json(over)
        names = df.columns
        df = df.join(F.broadcast(top.toDF(*(f"_{c}" for c in names)))).select(*(F.coalesce(f"_{c}", c).alias(c) for c in names))
    return df.withColumns({"K_opt": F.coalesce("K_opt", "K"), "dist_coeffs_opt": F.coalesce("dist_coeffs_opt", "dist_coeffs")})


def read_matches(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """Pair matches of Parquet files; references to absent images go."""
    m = spark.read.parquet(path)
    for side in ("image_i", "image_j"):
        m = m.join(images.select(F.col("name").alias(side)), side, "left_semi")
    return m.select("image_i", "image_j", "ord", "kp_i", "kp_j")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, image) of a JSON list of lists of names; unreadable text is an empty list."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("group_id", "names")).select("group_id", F.explode("names").alias("image"))


def read_annotations(spark: SparkSession, path: str, prefix: str = "id") -> DataFrame:
    """(id_prefix, id, lat_deg, lon_deg, alt_m, comment) of the three shapes annotation files have had.

    An object with markers, a bare list of objects, or a bare list of [lat, lon, alt, comment];
    missing ids count on from zero by position.
    """
    v = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    marker = "array<variant>"
    m = v.select(
        F.coalesce(F.try_variant_get("v", "$.id_prefix", "string"), F.lit(prefix)).alias("id_prefix"),
        F.posexplode(F.coalesce(F.try_variant_get("v", "$.markers", marker), F.try_variant_get("v", "$", marker))).alias("pos", "m"),
    )
    get = lambda name, k, kind: F.coalesce(F.try_variant_get("m", f"$.{name}", kind), F.try_variant_get("m", f"$[{k}]", kind))
    return m.select(
        "id_prefix", F.coalesce(F.try_variant_get("m", "$.id", "int"), F.col("pos")).alias("id"),
        get("lat_deg", 0, "double").alias("lat_deg"), get("lon_deg", 1, "double").alias("lon_deg"), get("alt_m", 2, "double").alias("alt_m"), get("comment", 3, "string").alias("comment"),
    )


def read_annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, lat_deg, lon_deg, alt_m) of CSV files whose headers only contain the words latitude, longitude, altitude and objectid."""
    df = spark.read.option("header", True).csv(path)

    def named(word: str, kind: str) -> Column:
        found = next((c for c in df.columns if word in c.lower()), None)
        return (F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind))

    return df.select(named("objectid", "int").alias("id"), named("latitude", "double").alias("lat_deg"), named("longitude", "double").alias("lon_deg"), F.coalesce(named("altitude", "double"), F.lit(0.0)).alias("alt_m"))


def crowd_labels(sets: DataFrame, subjects: DataFrame, classifications: DataFrame) -> DataFrame:
    """(project_path, filename, x, y, r, value) of classifications joined with their subjects and sets; unknown ones go.

    subjects.metadata and classifications.metadata and annotations are JSON text. Labels of
    tools above 0 are kept only where they have a radius; without subject dimensions none is.
    """
    s = subjects.select("subject_id", "subject_set_id", F.get_json_object("metadata", "$.filename").alias("filename"))
    shape = "array<struct<value:array<struct<x:double,y:double,r:double,tool:int,details:array<struct<value:string>>>>>>"
    known = F.get_json_object("metadata", "$.subject_dimensions[0]")
    c = classifications.filter(known.isNotNull() & (known != "null"))
    c = c.select(F.col("subject_ids").alias("subject_id"), F.explode(F.from_json("annotations", shape)).alias("a"))
    c = c.select("subject_id", F.explode("a.value").alias("m")).filter((F.coalesce("m.tool", F.lit(0)) == 0) | F.col("m.r").isNotNull())
    return c.join(s, "subject_id").join(sets, "subject_set_id").select("project_path", "filename", "m.x", "m.y", "m.r", F.get("m.details.value", F.lit(0)).alias("value"))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame rates of a video, with short column names; rows where all three axes are above 0.2 rad/s count as still."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = df.select(*(F.col(f"`{c}`").cast("double").alias(c.split(" (")[0].replace(" ", "_")) for c in df.columns))
    wild = (F.abs("p") > 0.2) & (F.abs("q") > 0.2) & (F.abs("r") > 0.2)
    return df.withColumns({c: F.when(wild, 0.0).otherwise(F.col(c)) for c in "pqr"}).withColumn("frame", F.col("frame").cast("int"))

"""Typed readers of a project's saved state: features, descriptors, chains, pair estimates, surfaces, histograms.

Each state is a folder of Parquet files under a fixed schema; a column that a file lacks is null,
and one that it has besides is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "features": "image string, kp int, u double, v double, size double, angle double, response double, octave int, class_id int",
    "descriptors": "image string, kp int, descriptor array<float>",
    "chains": "chain long, pos int, image string, kp int, u double, v double, n double, e double, d double, group_id int",
    "pairs": "image_i string, image_j string, n int, surface_m double, std_m double, yaw_error_deg double, dist_m double",
    "images": "image string, tri_surface_m double, srtm_surface_m double, yaw_error_deg double",
    "surface": "x double, y double, z double",
    "histograms": "image string, channel int, bin int, count double",
}


def read_state(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The state ``kind`` (a key of SCHEMAS) at ``path``."""
    return spark.read.schema(SCHEMAS[kind]).parquet(path)


def write_state(df: DataFrame, path: str, kind: str) -> None:
    """Writes the columns of the state ``kind``; columns that ``df`` lacks are null."""
    own = {c.lower() for c in df.columns}
    fields = [x.split(" ") for x in SCHEMAS[kind].split(", ")]
    df.select(*((F.col(c).cast(t) if c in own else F.lit(None).cast(t)).alias(c) for c, t in fields)).write.mode("overwrite").parquet(path)


def with_images(state: DataFrame, images: DataFrame) -> DataFrame:
    """Rows of images that exist (by ``name``); others refer to nothing."""
    return state.join(images.select(F.col("name").alias("image")), "image", "left_semi")


def dangling(chains: DataFrame, features: DataFrame) -> DataFrame:
    """Observations whose keypoint is not among the features: a state that needs repair."""
    return chains.join(features.select("image", "kp"), ["image", "kp"], "left_anti")


def feature_sample(features: DataFrame, chains: DataFrame, share: float = 0.02, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A seeded share of the features (by hashes of image and keypoint), numbered anew in each image, and the chains' references to them."""
    from pyspark.sql.window import Window

    mark = F.pmod(F.xxhash64(F.lit(seed), "image", "kp"), F.lit(1_000_000)) < int(share * 1_000_000)
    some = features.filter(mark).withColumn("new", F.row_number().over(Window.partitionBy("image").orderBy("kp")) - 1)
    kept = chains.join(some.select("image", "kp", "new"), ["image", "kp"]).withColumn("kp", F.col("new")).drop("new")
    return some.withColumn("kp", F.col("new")).drop("new"), kept.select(*chains.columns)

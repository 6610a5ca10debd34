"""Terrain tiles: names, raw 16-bit grids, bilinear heights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples on a side of a tile of one degree.
SIDE = 1201


def tile_name(lat: Column, lon: Column) -> Column:
    """N/S and two digits, E/W and three digits of the south-west corner, zero-padded."""
    part = lambda x, a, b, n: F.concat(F.when(x >= 0, a).otherwise(b), F.lpad(F.abs(F.floor(x)).cast("string"), n, "0"))
    return F.concat(part(lat, "N", "S", 2), part(lon, "E", "W", 3))


def unpack(content: bytes, signed: bool = False, void_above: int = 10_000) -> np.ndarray:
    """Big-endian 16-bit samples as rows from north to south. Unsigned by default, so cells below the sea and voids become 0."""
    side = int(round((len(content) // 2) ** 0.5))
    z = np.frombuffer(content, dtype=">i2" if signed else ">u2").astype(np.int32).reshape(side, side)
    return np.where((z > void_above) | (z == -32768), 0, z)


def read_tiles(spark: SparkSession, path: str, signed: bool = False) -> DataFrame:
    """(tile, row, col, z) of raw .hgt files; each file is unpacked by one task, a row of samples at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(path).select(F.regexp_extract("path", r"([NS]\d+[EW]\d+)", 1).alias("tile"), "content")

    def run(frames):
        import pandas as pd

        for f in frames:
            for tile, content in zip(f["tile"], f["content"]):
                for k, line in enumerate(unpack(content, signed)):
                    yield pd.DataFrame({"tile": tile, "row": k, "col": np.arange(len(line)), "z": line})

    return files.mapInPandas(run, "tile string, row int, col int, z int")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(tile, region) of catalog text files, one archive name a line; the region is the file's name."""
    lines = spark.read.text(path).withColumn("region", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return lines.filter(F.length(F.trim("value")) > 0).select(F.regexp_replace(F.trim("value"), r"\.hgt(\.zip)?$", "").alias("tile"), "region")


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, step: float, missing: float = -32768.0) -> DataFrame:
    """``points`` with ``z`` from a regular grid (i, j, z): four equi-joins on the corners of the cell; ``missing`` outside."""
    p = points.withColumns({"_i": F.floor(F.col(x) / step), "_j": F.floor(F.col(y) / step)})
    p = p.withColumns({"_fx": F.col(x) / step - F.col("_i"), "_fy": F.col(y) / step - F.col("_j")})
    total = F.lit(0.0)
    for di in (0, 1):
        for dj in (0, 1):
            g = grid.select((F.col("i") - di).alias("_i"), (F.col("j") - dj).alias("_j"), F.col("z").alias(f"_z{di}{dj}"))
            p = p.join(g, ["_i", "_j"], "left")
            wx, wy = (F.col("_fx") if di else 1 - F.col("_fx")), (F.col("_fy") if dj else 1 - F.col("_fy"))
            # a corner without weight need not exist
            total = total + F.when((wx == 0) | (wy == 0), 0.0).otherwise(wx * wy * F.col(f"_z{di}{dj}"))
    return p.withColumn("z", F.coalesce(total, F.lit(missing))).select(*points.columns, "z")

"""Regular grids: filling of empty bins, rays against a surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.terrain import bilinear
from .graph import settled


def fill_bins(binned: DataFrame, nx: int, ny: int) -> DataFrame:
    """(cx, cy, mean, n) of all bins that can be reached from the filled ones of an nx by ny grid.

    In each round every empty bin beside filled ones takes the mean of its 3 x 3 neighbours weighted
    by their counts, and their mean count, all at once; rounds go on until none is filled. Each
    round is written, so the plan does not grow.
    """
    now = settled(binned.select("cx", "cy", "mean", F.col("n").cast("long").alias("n")))
    filled = now.count()
    step = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    while filled:
        near = now.withColumn("dx", step).withColumn("dy", step).select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "mean", "n")
        near = near.filter((F.col("cx") >= 0) & (F.col("cx") < nx) & (F.col("cy") >= 0) & (F.col("cy") < ny)).join(now.select("cx", "cy"), ["cx", "cy"], "left_anti")
        new = near.groupBy("cx", "cy").agg((F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.floor(F.sum("n") / F.count("*")).alias("n"))
        now = settled(now.unionByName(new.filter("mean is not null")))
        was, filled = filled, now.count()
        if filled == was:
            break
    return now


def ray_surface(rays: DataFrame, grid: DataFrame, step: float, height: Column | None = None, *, eps: float = 0.01, most: int = 25) -> DataFrame:
    """``rays`` (n, e, d, vn, ve, vd) with the place (x, y, z) where each meets the surface of a grid (i, j, z).

    The ray is followed down to the height of the ground under the last place until that height
    and the place's are within ``eps``, ``most`` times at most; where the grid has no height the
    last known one (at first 0) stays. Rays that do not point down stay at their start. The state
    is written every five steps, and rows that have settled are passed over by the conditions.
    """
    own = rays.columns
    p = rays.withColumns({"x": F.col("n"), "y": F.col("e"), "z": F.col("d") * 1.0})

    def grounded(p: DataFrame, before: Column) -> DataFrame:
        g = bilinear(p.withColumnRenamed("z", "_d"), grid, "x", "y", step, float("nan"))
        return g.withColumn("_g", F.coalesce(F.nanvl("z", F.lit(None).cast("double")), before)).drop("z").withColumnRenamed("_d", "z")

    p = grounded(p, F.lit(0.0))
    for k in range(most):
        open_ = (F.abs(F.col("z") + F.col("_g")) > eps) & (F.col("vd") > 0)
        down = -(F.col("d") + F.col("_g")) / F.col("vd")
        move = lambda c, at: F.when(F.col("_open"), at).otherwise(F.col(c))
        p = p.withColumn("_open", open_)
        p = p.withColumns({"x": move("x", F.col("n") + F.col("vn") * down), "y": move("y", F.col("e") + F.col("ve") * down), "z": move("z", -F.col("_g"))}).withColumnRenamed("_g", "_was")
        p = grounded(p, F.col("_was")).drop("_was", "_open")
        if k % 5 == 4 and k + 1 < most:
            p = settled(p)
            if not p.filter((F.abs(F.col("z") + F.col("_g")) > eps) & (F.col("vd") > 0)).limit(1).count():
                break
    return p.select(*own, "x", "y", "z")

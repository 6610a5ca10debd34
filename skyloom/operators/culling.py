"""Outlier limits, deletion of observations and of chains that become too short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table, which is broadcast."""
    return df.join(F.broadcast(stats))


def sigma_limit(df: DataFrame, col: str, k: float) -> DataFrame:
    """One row: mean + k population standard deviations as ``limit``."""
    return df.agg((F.avg(col) + k * F.stddev_pop(col)).alias("limit"))


def drop_outliers(df: DataFrame, col: str, k: float) -> DataFrame:
    """Rows at or below mean + k sigma."""
    return one_row(df, sigma_limit(df, col, k)).filter(F.col(col) <= F.col("limit")).drop("limit")


def keep_chains(obs: DataFrame, least: int, chain: str = "chain_id") -> DataFrame:
    """Observations of chains that have ``least`` or more of them."""
    long = obs.groupBy(chain).count().filter(F.col("count") >= least).select(chain)
    return obs.join(long, chain, "left_semi")


def cull_until_stable(df: DataFrame, col: str, k: float) -> DataFrame:
    """Cuts at mean + k sigma again and again, until nothing is above the limit.

    A round needs the limit alone, so it is one aggregate over the rows below the last limit:
    nothing is rewritten, and the lineage stays one filter. Each round cuts a row at least, so it ends.
    """
    limit = None
    while True:
        now = df if limit is None else df.filter(F.col(col) <= limit)
        new, top = now.agg(F.avg(col) + k * F.stddev_pop(col), F.max(col)).first()
        if new is None or top <= new:
            return now
        limit = new

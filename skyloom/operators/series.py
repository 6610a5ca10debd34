"""Time series: rates, smoothing, resampling, correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .graph import settled
from .joins import interpolate


def rates(df: DataFrame, by: list[str], time: str, value: str, order: list[str]) -> DataFrame:
    """Change over time since the row before, 0 for the first row and where time stands still."""
    w = Window.partitionBy(*by).orderBy(*order)
    dt, dx = F.col(time) - F.lag(time).over(w), F.col(value) - F.lag(value).over(w)
    return df.withColumn("rate", F.coalesce(F.when(dt > 0, dx / dt), F.lit(0.0)))


def trailing_ewma(df: DataFrame, by: list[str], order: list[str], value: str, k: float, terms: int, name: str = "ewma") -> DataFrame:
    """The recurrence y = k * x + (1 - k) * y cut to its last ``terms`` values, normalised; stays in the JVM.

    The weights left out sum to (1 - k) ** terms.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-terms + 1, 0)
    xs = F.reverse(F.collect_list(F.col(value).cast("double")).over(w))
    weights = F.array(*(F.lit((1 - k) ** i) for i in range(terms)))
    total = F.aggregate(F.zip_with(xs, F.slice(weights, F.lit(1), F.size(xs)), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
    mass = F.aggregate(F.slice(weights, F.lit(1), F.size(xs)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(name, total / mass)


def ewma(df: DataFrame, by: list[str], order: str, value: str, k: float, name: str = "ewma") -> DataFrame:
    """y = k * x + (1 - k) * y in order within each key, from the first value; numpy, one pass over a key."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(g):
        g = g.sort_values(order, kind="stable")
        x, y, out = g[value].to_numpy(dtype=float), None, np.empty(len(g))
        for i, v in enumerate(x):
            y = v if y is None else k * v + (1 - k) * y
            out[i] = y
        return g.assign(**{name: out})

    return df.groupBy(*by).applyInPandas(run, schema)


def resample(series: DataFrame, by: list[str], time: str, value: str, hz: float) -> DataFrame:
    """Evenly spaced samples of each key: round(span * hz) intervals from its first time, linear in between."""
    span = series.groupBy(*by).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    n = F.bround((F.col("_t1") - F.col("_t0")) * hz).cast("long")
    grid = span.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    grid = grid.select(*by, "i", (F.col("_t0") + (F.col("_t1") - F.col("_t0")) * F.col("i") / F.col("_n")).alias(time))
    return interpolate(grid, series.select(*by, time, value), time, value, by)


def best_lag(a: DataFrame, b: DataFrame, by: list[str], widest: int) -> DataFrame:
    """The shift of b (in samples, |shift| <= widest) with the largest sum of products with a; ties to the smallest shift.

    Both have (by, i, x) on a common grid. Each sample of a meets 2 * widest + 1 samples of b.
    """
    shifts = F.explode(F.sequence(F.lit(-widest), F.lit(widest)))
    j = a.withColumn("lag", shifts).withColumn("i", F.col("i") + F.col("lag")).join(b.withColumnRenamed("x", "y"), [*by, "i"])
    scored = j.groupBy(*by, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 6)), "lag")
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def fill_along(df: DataFrame, index: str, value: str) -> DataFrame:
    """(index, <value>_at): nulls filled linearly along the index of one long series, beyond the ends by the last known value, without any by 0.

    Rows go to ranges of the index; a range is filled with its own known values and the nearest one
    before and after it, which come from two points a range. Of values at one index the smallest counts;
    rows with a null index are left out.
    """
    p = settled(df.select(F.col(index).cast("double").alias("t"), F.col(value).cast("double").alias("x")).filter("t is not null").repartitionByRange("t").withColumn("part", F.spark_partition_id()))
    point = F.when(F.col("x").isNotNull(), F.struct("t", "x"))
    ends = p.groupBy("part").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    order = Window.orderBy("part")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = ends.select("part", before.alias("b"), after.alias("a")).select("part", F.explode(F.array("b", "a")).alias("e")).filter("e is not null").select("part", "e.t", "e.x")
    known = p.filter("x is not null").select("part", "t", "x").unionByName(near)
    out = interpolate(p.select("part", "t"), known, "t", "x", ["part"], F.coalesce(F.col("_a.x"), F.col("_b.x"), F.lit(0.0)))
    return out.select(F.col("t").alias(index), F.col("x_at").alias(f"{value}_at"))


def butterworth(cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the order-2 low-pass filter; cut is a fraction of the Nyquist rate."""
    c = 1 / np.tan(np.pi * cut / 2)
    a0 = 1 + np.sqrt(2) * c + c * c
    return np.array([1, 2, 1]) / a0, np.array([1, 2 * (1 - c * c) / a0, (1 - np.sqrt(2) * c + c * c) / a0])


def _biquad(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed, started in the steady state of the first value."""
    z2 = (b[2] - a[2]) * x[0]
    z1 = (b[1] - a[1]) * x[0] + z2
    out = np.empty_like(x)
    for i, v in enumerate(x):
        y = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        out[i] = y
    return out


def zero_phase(x: np.ndarray, cut: float, pad: int = 9) -> np.ndarray:
    """Forward and backward filtering with odd reflection at both ends."""
    x = np.asarray(x, dtype=float)
    if len(x) < 2:
        return x
    pad = min(pad, len(x) - 1)
    b, a = butterworth(cut)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _biquad(b, a, _biquad(b, a, y)[::-1])[::-1]
    return y[pad : len(y) - pad] if pad else y


def smooth(df: DataFrame, by: list[str], order: str, value: str, cut: float, name: str = "smooth") -> DataFrame:
    """Zero-phase order-2 Butterworth smoothing of each key's series."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(g):
        g = g.sort_values(order, kind="stable")
        return g.assign(**{name: zero_phase(g[value].to_numpy(), cut)})

    return df.groupBy(*by).applyInPandas(run, schema)

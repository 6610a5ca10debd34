"""Band, distance, nearest and as-of joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def suffixed(df: DataFrame, suffix: str = "_2") -> DataFrame:
    return df.toDF(*(f"{c}{suffix}" for c in df.columns))


def sequence_pairs(df: DataFrame, idx: str, width: int) -> DataFrame:
    """Pairs with idx < idx_2 <= idx + width: each row is sent to its ``width`` successors and met by an equi-join."""
    to = F.explode(F.sequence(F.col(idx) + 1, F.col(idx) + width))
    return df.withColumn("_to", to).join(suffixed(df), F.col("_to") == F.col(f"{idx}_2")).drop("_to")


def _cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})


def within(left: DataFrame, right: DataFrame, x: str, y: str, reach: float) -> DataFrame:
    """Pairs at a distance of ``reach`` or less, with ``dist``; the right side's columns get the suffix _2.

    Both sides fall into cells as wide as the reach; a left row meets the 3 x 3 cells around its own.
    """
    near = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    a = _cells(left, x, y, reach).withColumn("_dx", near).withColumn("_dy", near)
    a = a.withColumns({"_kx": F.col("_cx") + F.col("_dx"), "_ky": F.col("_cy") + F.col("_dy")}).drop("_cx", "_cy", "_dx", "_dy")
    b = suffixed(_cells(right, x, y, reach))
    d = F.hypot(F.col(x) - F.col(f"{x}_2"), F.col(y) - F.col(f"{y}_2"))
    j = a.join(b, (F.col("_kx") == F.col("_cx_2")) & (F.col("_ky") == F.col("_cy_2")))
    return j.withColumn("dist", d).filter(F.col("dist") <= reach).drop("_kx", "_ky", "_cx_2", "_cy_2")


def smallest(df: DataFrame, key: str, place: list[Column], k: int) -> DataFrame:
    """Of the rows that share a place those with the k smallest keys."""
    w = Window.partitionBy(*place).orderBy(key)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, x: str, y: str, reach: float, k: int = 1, metric: Column | None = None) -> DataFrame:
    """The k best right rows of each left row by ``metric`` (default: the distance), ties to the smaller right id, with ``rank``.

    The metric may read all columns of the pair and must not be below the distance ``dist``. Cells
    of ``reach`` are tried first; a left row is answered when its k-th metric is within the reach,
    as no farther row can beat it. The others go on with the reach doubled, so dense places stay
    cheap. Without a metric of the caller's, rows that share a place have the same answers, and of the
    right rows of a place only the k smallest ids can be among them: places meet, and the answers go
    back to the rows. At the end, when the reach spans both sides, every row has met all. Each round's answers
    and the rows that go on are written, so the plan stays the same however often the reach doubles.
    """
    from .graph import settled

    if metric is None:
        # the minus zero is the zero's place
        place = [F.col(c) + F.lit(0.0) for c in (x, y)]
        spot = left.select(place[0].alias(x), place[1].alias(y)).distinct().withColumn("_place", F.struct(x, y))
        few = smallest(right, right_id, place, k)
        near = nearest(spot, few, "_place", right_id, x, y, reach, k, F.col("dist"))
        answers = near.select(F.col("_place").alias("_at"), *(f"{c}_2" for c in right.columns), "dist", "metric", "rank")
        return left.join(answers, F.struct(*place) == F.col("_at")).drop("_at")
    ends = [d.agg(F.max(F.abs(x)) + F.max(F.abs(y))).first()[0] for d in (left, right)]
    widest = reach if None in ends else float(sum(ends))
    out, rest = None, left
    w = Window.partitionBy(left_id).orderBy("metric", f"{right_id}_2")
    while True:
        got = within(rest, right, x, y, reach).withColumn("metric", F.col("dist") if metric is None else metric)
        got = settled(got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        last = reach >= widest
        answered = got.filter((F.col("rank") == k) & (F.col("metric") <= reach)).select(left_id)
        full = got if last else got.join(answered, left_id, "left_semi")
        out = full if out is None else out.unionByName(full)
        if last:
            return out
        rest = settled(rest.join(answered, left_id, "left_anti"))
        reach *= 2
        if rest.limit(1).count() == 0:
            return out


def asof(queries: DataFrame, series: DataFrame, time: str, values: list[str], by: list[str]) -> DataFrame:
    """Each query row with the last series values at or before its time (``<value>_at``), by a union and one window.

    Queries come after series rows of the same time.
    """
    q = queries.select(*by, time, F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_row"), *(F.lit(None).cast(series.schema[v].dataType).alias(v) for v in values))
    s = series.select(*by, time, F.lit(0).alias("_q"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), *values)
    w = Window.partitionBy(*by).orderBy(time, "_q").rowsBetween(Window.unboundedPreceding, 0)
    u = q.unionByName(s).withColumns({f"_at_{v}": F.last(v, ignorenulls=True).over(w) for v in values})
    return u.filter("_q = 1").select("_row.*", *(F.col(f"_at_{v}").alias(f"{v}_at") for v in values))


def interpolate(queries: DataFrame, series: DataFrame, time: str, value: str, by: list[str], outside: Column | None = None) -> DataFrame:
    """Each query row with the series linearly interpolated at its time (``<value>_at``); ``outside`` (default 0) beyond the ends.

    The point before and the point after are both the last one seen, in ascending and in descending
    order, as a frame that looks ahead to the end costs the square of a key's rows.
    """
    q = queries.select(*by, time, F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_row"), F.lit(None).cast("struct<t:double,x:double>").alias("_p"))
    s = series.groupBy(*by, time).agg(F.min(value).alias(value))
    s = s.select(*by, time, F.lit(0).alias("_q"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("x")).alias("_p"))
    before = Window.partitionBy(*by).orderBy(time, "_q").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc(time), "_q").rowsBetween(Window.unboundedPreceding, 0)
    u = q.unionByName(s).withColumns({"_a": F.last("_p", ignorenulls=True).over(before), "_b": F.last("_p", ignorenulls=True).over(after)})
    a, b, t = F.col("_a"), F.col("_b"), F.col(time)
    lerp = F.when(a.t == b.t, a.x).otherwise(a.x + (b.x - a.x) * (t - a.t) / F.nullif(b.t - a.t, F.lit(0.0)))
    return u.filter("_q = 1").select("_row.*", F.coalesce(lerp, F.lit(0.0) if outside is None else outside).alias(f"{value}_at"))

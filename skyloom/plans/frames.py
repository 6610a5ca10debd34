"""Stateful filters on tables (T01-T15), by the steps that streams run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import filters as f
from ..streaming import run
from .base import query, r

RANKED = "o as (select k, event_id, x, t, row_number() over (partition by k order by event_id) as rn from series)"


#: Added before rounding in both engines: exact halves of the last digit, which two-decimal values give, then round alike.
NUDGE = 3e-9


def filtered(series, filt, digits=6):
    s = series.select("k", F.col("event_id").cast("double").alias("t"), "x")
    out = run.on_table(s, "k", "t", "x", filt)
    return out.select("k", F.col("t").cast("long").alias("event_id"), *(r(F.col(c) + NUDGE, digits).alias(c) for c in filt.columns))


@query("t01_rates", "select k, event_id, round(coalesce((x - lag(x) over w) / (event_id - lag(event_id) over w), 0) + 3e-9, 6) + 0e0 as rate from series window w as (partition by k order by event_id)")
def _(t):
    return filtered(t.series, f.Rates())


@query("t02_warm_up", f"with recursive {RANKED}, y as (select k, event_id, rn, x as low from o where rn = 1 union all select o.k, o.event_id, o.rn, (least(o.rn / 30e0, 15) * 30 - 1) / (least(o.rn / 30e0, 15) * 30) * y.low + o.x / (least(o.rn / 30e0, 15) * 30) from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round(low + 3e-9, 6) as low from y")
def _(t):
    return filtered(t.series, f.WarmUpLowPass())


@query("t03_running_mean", f"with recursive {RANKED}, y as (select k, event_id, rn, x as mean from o where rn = 1 union all select o.k, o.event_id, o.rn, y.mean + (o.x - y.mean) / least(o.rn, 10) from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round(mean + 3e-9, 6) as mean from y")
def _(t):
    """The mean whose weight stops growing at a cap (T03); ten rows here, so that the tables' keys pass it."""
    return filtered(t.series, f.RunningMean(cap=10))


@query("t04_welford", "select k, event_id, round(avg(x) over w + 3e-9, 6) as mean, round(var_pop(x) over w + 3e-9, 6) + 0e0 as var from series window w as (partition by k order by event_id rows unbounded preceding)")
def _(t):
    return filtered(t.series, f.Welford())


@query("t07_since_emitted", f"with recursive {RANKED}, y as (select k, event_id, rn, event_id as last, true as out from o where rn = 1 union all select o.k, o.event_id, o.rn, case when o.event_id - y.last >= 300 then o.event_id else y.last end, o.event_id - y.last >= 300 from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, (event_id - coalesce(lag(event_id) over (partition by k order by rn), event_id))::double as gap from y where out")
def _(t):
    return filtered(t.series, f.SinceEmitted(interval=300.0))


@query("t08_distance_or_time", f"with recursive {RANKED}, y as (select k, event_id, rn, event_id as last, x as lx, 0e0 as gap, true as out from o where rn = 1 union all select o.k, o.event_id, o.rn, case when o.event_id - y.last >= 500 or abs(o.x - y.lx) >= 40 then o.event_id else y.last end, case when o.event_id - y.last >= 500 or abs(o.x - y.lx) >= 40 then o.x else y.lx end, (o.event_id - y.last) * 1e0, o.event_id - y.last >= 500 or abs(o.x - y.lx) >= 40 from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, gap from y where out")
def _(t):
    return filtered(t.series, f.SinceEmitted(interval=500.0, distance=40.0))


@query("t11_fast_slow", f"with recursive {RANKED}, y as (select k, event_id, rn, x as f, x as s, x as b, 0e0 as p from o where rn = 1 union all select o.k, o.event_id, o.rn, 0.5e0 * y.f + 0.5e0 * o.x, 0.96e0 * y.s + (1 - 0.96e0) * o.x, 0.99e0 * y.b + (1 - 0.99e0) * o.x, greatest(0.95e0 * y.p, abs(0.5e0 * y.f + 0.5e0 * o.x - 0.96e0 * y.s - (1 - 0.96e0) * o.x)) from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round(f + 3e-9, 6) as fast_avg, round(s + 3e-9, 6) as slow_avg, round(b + 3e-9, 6) as back_avg, round(p + 3e-9, 6) as peak from y")
def _(t):
    return filtered(t.series, f.FastSlow())


@query("t12_asymmetric", f"with recursive {RANKED}, y as (select k, event_id, rn, case when x > 0 then 0.1e0 * x else 0.02e0 * x end as level from o where rn = 1 union all select o.k, o.event_id, o.rn, case when o.x > y.level then 0.9e0 * y.level + (1 - 0.9e0) * o.x else 0.98e0 * y.level + (1 - 0.98e0) * o.x end from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round(level + 3e-9, 6) as level from y")
def _(t):
    return filtered(t.series, f.AsymmetricEwma())


@query("t13_stabilizer", f"with recursive {RANKED}, y as (select k, event_id, rn, x as p, 0.1e0 * x + 0.02e0 * (x - 0.1e0 * x) as s from o where rn = 1 union all select o.k, o.event_id, o.rn, y.p + o.x, 0.9e0 * y.s + 0.1e0 * (y.p + o.x) + 0.02e0 * (y.p + o.x - 0.9e0 * y.s - 0.1e0 * (y.p + o.x)) from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round(p + 3e-9, 6) + 0e0 as path, round(s + 3e-9, 6) + 0e0 as smoothed, round(s - p + 3e-9, 6) + 0e0 as correction from y")
def _(t):
    return filtered(t.series, f.Stabilizer())


@query("t09_streaming_modes")
def _(t):
    return filtered(t.series, f.StreamingModes())


@query("t10_window_modes")
def _(t):
    return filtered(t.series, f.WindowModes())


@query("t14_pair_statistics", "select l_suppkey as image, round(sum(case when l_quantity % 40 < 25 then l_extendedprice * l_quantity end) / nullif(sum(case when l_quantity % 40 < 25 then l_quantity end), 0), 3) as mean, count(*) filter (where l_quantity % 40 < 25) as pairs from lineitem group by l_suppkey")
def _(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("image"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("weight"), (F.col("l_quantity") % 40).alias("std"))
    return run.pair_statistics(e).select("image", r("mean", 3).alias("mean"), "pairs")


@query("t15_latest", "with k as (select k, event_id, x, row_number() over (partition by k order by event_id desc) as rn from series) select k, event_id, x from k where rn = 1")
def _(t):
    return run.latest(t.series.select("k", "event_id", "x"), "k", "event_id")

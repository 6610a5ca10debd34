"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import query, r


@query("f01_attitude_gate", "select image_idx, pitch_deg, roll_deg from img where case when make = 'DJI' then pitch_deg <= -45 else abs(roll_deg) <= 25 and abs(pitch_deg) <= 25 end")
def _(t):
    """Gimballed makes must look down; others must fly level."""
    level = (F.abs("roll_deg") <= 25) & (F.abs("pitch_deg") <= 25)
    return t.img.filter(F.when(F.col("make").isin("DJI"), F.col("pitch_deg") <= -45).otherwise(level)).select("image_idx", "pitch_deg", "roll_deg")


@query("f02_existing_images", "select image_idx, lat_deg from img where image_idx in (select image_idx from obs where v >= 50)")
def _(t):
    return t.img.select("image_idx", "lat_deg").join(t.obs.filter("v >= 50").select("image_idx"), "image_idx", "left_semi")


@query("f05_minimum_pairs", "select chain_id, image_idx, round(u, 4) as u from obs qualify count(*) over (partition by chain_id) >= 35")
def _(t):
    n = F.count("*").over(Window.partitionBy("chain_id"))
    return t.obs.withColumn("n", n).filter("n >= 35").select("chain_id", "image_idx", r("u", 4).alias("u"))


@query("f06_prefix_break", """
with o as (select chain_id, image_idx, u, v, row_number() over (partition by chain_id order by v, u, image_idx) as rn from obs),
k as (select *, min(case when v <= 30 and u <= 800 then 1 else 0 end) over (partition by chain_id order by rn) as ok from o) select chain_id, image_idx, rn from k where ok = 1""")
def _(t):
    """Rows in order up to the first that breaks a limit."""
    w = Window.partitionBy("chain_id").orderBy("v", "u", "image_idx")
    ok = F.min(F.when((F.col("v") <= 30) & (F.col("u") <= 800), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.obs.withColumns({"rn": F.row_number().over(w).cast("long"), "ok": ok}).filter("ok = 1").select("chain_id", "image_idx", "rn")


@query("f07_used_keypoints", "select id, u, v from uv where id in (select chain_id from obs where v < 2)")
def _(t):
    return t.uv.join(t.obs.filter("v < 2").select(F.col("chain_id").alias("id")).distinct(), "id", "left_semi").select("id", "u", "v")


@query("f08_blow_up", "select l_partkey as id, count(*) as n, round(stddev_pop(l_extendedprice), 4) as std from lineitem group by l_partkey having not (stddev_pop(l_extendedprice) >= 28000 and count(*) < 30)")
def _(t):
    g = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), F.stddev_pop("l_extendedprice").alias("s"))
    return g.filter("not (s >= 28000 and n < 30)").select("id", "n", r("s", 4).alias("std"))


@query("f09_trust", "select l_suppkey as id, count(*) filter (where l_quantity % 40 < 25) as trusted, count(*) filter (where l_quantity >= 0.5e0 and abs(l_discount * 1000 - 50) <= 30.5e0) as yaw_trusted from lineitem group by l_suppkey")
def _(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_quantity") % 40 < 25).alias("trusted"), F.count_if((F.col("l_quantity") >= 0.5) & (F.abs(F.col("l_discount") * 1000 - 50) <= 30.5)).alias("yaw_trusted"))


@query("f12_altitude_gate", "with g as (select avg(d) as m, stddev_pop(d) as s from feat) select chain_id, d from feat, g where abs(d - m) < 1.5e0 * s")
def _(t):
    g = F.broadcast(t.feat.agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s")))
    return t.feat.join(g).filter(F.abs(F.col("d") - F.col("m")) < 1.5 * F.col("s")).select("chain_id", "d")


@query("f15_angle_stats", "with a as (select image_idx, degrees(atan2(v, u / 20)) as angle from obs) select image_idx, round(avg(angle), 5) as mean, round(min(angle), 6) as least from a group by image_idx having avg(angle) < 48 or stddev_pop(angle) > 22.6e0 or min(angle) < 1.2e0")
def _(t):
    a = t.obs.select("image_idx", F.degrees(F.atan2(F.col("v"), F.col("u") / 20)).alias("angle"))
    g = a.groupBy("image_idx").agg(F.avg("angle").alias("m"), F.stddev_pop("angle").alias("s"), F.min("angle").alias("l"))
    return g.filter("m < 48 or s > 22.6 or l < 1.2").select("image_idx", r("m", 5).alias("mean"), r("l").alias("least"))


@query("f16_high_ray", "select id, case when degrees(atan2(v, u)) < 30 then null else round(v / nullif(u, 0), 6) end as z from uv")
def _(t):
    """Rays too near the horizon have no value."""
    low = F.degrees(F.atan2("v", "u")) < 30
    return t.uv.select("id", F.when(~low, r(F.try_divide("v", "u"))).alias("z"))


@query("f18_chains_outside", "select chain_id, count(*) as n from obs where chain_id not in (select chain_id from obs join pose using (image_idx) where d > -102) group by chain_id")
def _(t):
    inside = t.obs.join(t.pose.filter("d > -102").select("image_idx"), "image_idx", "left_semi").select("chain_id")
    return t.obs.join(inside, "chain_id", "left_anti").groupBy("chain_id").agg(F.count("*").alias("n"))


@query("f19_agl", "select k, event_id, x from series where x >= 20 and t >= 1.0e9 and event_type <> 'click'")
def _(t):
    return t.series.filter("x >= 20 and t >= 1.0e9 and event_type <> 'click'").select("k", "event_id", "x")


@query("f20_motion_clamp", "select k, event_id, case when abs(x - 50) > 40 then 0e0 else x end as rate from series")
def _(t):
    return t.series.select("k", "event_id", F.when(F.abs(F.col("x") - 50) > 40, 0.0).otherwise(F.col("x")).alias("rate"))


@query("f21_error_limits", "select event_id, case when abs(x / 1000) > 0.08e0 then 0e0 else round(x / 1000, 8) end as err, case when x > 20 and x / 2 > 20 and x / 3 > 20 then 0e0 else x end as p from series")
def _(t):
    x = F.col("x")
    return t.series.select("event_id", F.when(F.abs(x / 1000) > 0.08, 0.0).otherwise(r(x / 1000, 8)).alias("err"), F.when((x > 20) & (x / 2 > 20) & (x / 3 > 20), 0.0).otherwise(x).alias("p"))


@query("f22_altitude_threshold", "with g as (select min(x) + 0.75e0 * (max(x) - min(x)) as lim from series) select k, event_id, x from series, g where x >= lim")
def _(t):
    g = F.broadcast(t.series.agg((F.min("x") + 0.75 * (F.max("x") - F.min("x"))).alias("lim")))
    return t.series.join(g).filter("x >= lim").select("k", "event_id", "x")


@query("f23_null_island", "select id, u, v from uv where not (abs(u - 2000) < 300 and abs(v - 1500) < 300)")
def _(t):
    return t.uv.filter(~((F.abs(F.col("u") - 2000) < 300) & (F.abs(F.col("v") - 1500) < 300))).select("id", "u", "v")


@query("f25_zero_missing", "select k, count(nullif(floor(x), 0)) as n, round(avg(nullif(floor(x), 0)), 6) as mean from series group by k")
def _(t):
    z = F.nullif(F.floor("x"), F.lit(0).cast("long"))
    return t.series.groupBy("k").agg(F.count(z).alias("n"), r(F.avg(z)).alias("mean"))


@query("f26_skinny_triangles", """
with a as (select id, u % 97 + 1 as x, v % 89 + 1 as y, (u + v) % 83 + 1 as z from uv), b as (select *, greatest(x, y, z) as hi, x + y + z - greatest(x, y, z) - least(x, y, z) as mid, least(x, y, z) as lo from a where x < y + z and y < x + z and z < x + y)
select id, round(degrees(acos(greatest(-1e0, least(1e0, (hi*hi + mid*mid - lo*lo) / (2*hi*mid))))), 5) as angle from b where (hi*hi + mid*mid - lo*lo) / (2*hi*mid) < cos(radians(10e0))""")
def _(t):
    """Triangles by their sides; those whose least angle is under 10 degrees go, by the law of cosines."""
    c = F.col
    a = t.uv.select("id", (c("u") % 97 + 1).alias("x"), (c("v") % 89 + 1).alias("y"), ((c("u") + c("v")) % 83 + 1).alias("z")).filter("x < y + z and y < x + z and z < x + y")
    a = a.withColumns({"hi": F.greatest("x", "y", "z"), "lo": F.least("x", "y", "z")}).withColumn("mid", c("x") + c("y") + c("z") - c("hi") - c("lo"))
    cos = (c("hi") * c("hi") + c("mid") * c("mid") - c("lo") * c("lo")) / (2 * c("hi") * c("mid"))
    return a.filter(cos < F.cos(F.radians(F.lit(10.0)))).select("id", r(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), 5).alias("angle"))


@query("f27_masked_keypoints", "with m as (select distinct floor(u / 200)::bigint as x, floor(v / 200)::bigint as y from uv where id % 7 = 0) select id, u, v from uv where not exists (select 1 from m where x = floor(u / 200)::bigint and y = floor(v / 200)::bigint)")
def _(t):
    cell = {"x": F.floor(F.col("u") / 200), "y": F.floor(F.col("v") / 200)}
    p = t.uv.withColumns(cell)
    return p.join(p.filter("id % 7 = 0").select("x", "y").distinct(), ["x", "y"], "left_anti").select("id", "u", "v")


@query("f28_track_clip", "with w as (select k, event_id, x, lag(x) over (partition by k order by t, event_id) as p from series) select k, event_id, x from w where p is null or abs(x - p) <= 30")
def _(t):
    w = Window.partitionBy("k").orderBy("t", "event_id")
    return t.series.withColumn("p", F.lag("x").over(w)).filter("p is null or abs(x - p) <= 30").select("k", "event_id", "x")

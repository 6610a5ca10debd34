"""Residual reports and culling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.culling import drop_outliers, keep_chains, one_row, sigma_limit
from .base import query, r

RES = """o as (select chain_id, image_idx, u, v, pose.n as pn, pose.e as pe, pose.d as pd, feat.n as fn, feat.e as fe, feat.d as fd from obs join pose using (image_idx) join feat using (chain_id)),
res as (select chain_id, image_idx, u, v, sqrt(((fn - pn) / 10 - u / 100) * ((fn - pn) / 10 - u / 100) + ((fe - pe) / 10 - v) * ((fe - pe) / 10 - v)) as res from o)"""


def residuals(t):
    """Each observation's reprojection residual: obs with its image's pose and its feature."""
    feat = t.feat.toDF("chain_id", "fn", "fe", "fd")
    df = t.obs.join(t.pose, "image_idx").join(feat, "chain_id")
    res = F.hypot((F.col("fn") - F.col("n")) / 10 - F.col("u") / 100, (F.col("fe") - F.col("e")) / 10 - F.col("v"))
    return df.select("chain_id", "image_idx", "u", "v", res.alias("res"))


@query("mre_by_image", f"""
with {RES}, g as (select avg(res) as m, stddev_pop(res) as s from res), i as (select image_idx, avg(res) as mean_res, max(res) as max_res, count(*) as n from res group by image_idx)
select p.image_idx, round(coalesce(mean_res, 9999e0), 5) as mean_res, round(coalesce(max_res, 9999e0), 5) as max_res, coalesce(i.n, 0) as n, coalesce(mean_res, 9999e0) > m + 0.3e0 * s as flagged
from pose p left join i using (image_idx), g order by 2 desc, 1""")
def _(t):
    """Mean and largest residual by image, images without observations last resort 9999, flagged above mean + k sigma."""
    res = residuals(t)
    by = res.groupBy("image_idx").agg(F.avg("res").alias("mean_res"), F.max("res").alias("max_res"), F.count("*").alias("n"))
    df = one_row(t.pose.select("image_idx").join(by, "image_idx", "left"), sigma_limit(res, "res", 0.3))
    mean = F.coalesce("mean_res", F.lit(9999.0))
    out = df.select("image_idx", r(mean, 5).alias("mean_res"), r(F.coalesce("max_res", F.lit(9999.0)), 5).alias("max_res"), F.coalesce("n", F.lit(0)).alias("n"), (mean > F.col("limit")).alias("flagged"))
    return out.orderBy(F.desc("mean_res"), "image_idx")


@query("a05_global_residual", f"with {RES} select round(avg(abs(res)), 6) as mean_abs, round(stddev_pop(res), 6) as std, round(max(abs(res)), 6) as largest, count(*) as n from res")
def _(t):
    return residuals(t).agg(r(F.avg(F.abs("res"))).alias("mean_abs"), r(F.stddev_pop("res")).alias("std"), r(F.max(F.abs("res"))).alias("largest"), F.count("*").alias("n"))


@query("a07_depth_by_image", """
with x as (select image_idx, feat.d - pose.d as depth from obs join pose using (image_idx) join feat using (chain_id))
select image_idx, round(avg(depth), 6) as mean, round(stddev_pop(depth), 6) as std, count(*) as n from x group by image_idx""")
def _(t):
    return depths(t).groupBy("image_idx").agg(r(F.avg("depth")).alias("mean"), r(F.stddev_pop("depth")).alias("std"), F.count("*").alias("n"))


def depths(t):
    feat = t.feat.select("chain_id", F.col("d").alias("fd"))
    return t.obs.join(t.pose.select("image_idx", "d"), "image_idx").join(feat, "chain_id").select("chain_id", "image_idx", (F.col("fd") - F.col("d")).alias("depth"))


@query("a08_depth_outliers", """
with x as (select chain_id, image_idx, feat.d - pose.d as depth from obs join pose using (image_idx) join feat using (chain_id)), m as (select image_idx, avg(depth) as mean from x group by image_idx)
select chain_id, round(avg(abs(depth - mean)), 6) as dev, count(*) as n from x join m using (image_idx) group by chain_id having count(*) >= 2""")
def _(t):
    x = depths(t)
    mean = x.groupBy("image_idx").agg(F.avg("depth").alias("mean"))
    return x.join(mean, "image_idx").groupBy("chain_id").agg(r(F.avg(F.abs(F.col("depth") - F.col("mean")))).alias("dev"), F.count("*").alias("n")).filter("n >= 2")


CULL = f"""{RES}, lim as (select avg(res) + 2e0 * stddev_pop(res) as lim from res), kept as (select chain_id, image_idx, u, v, res from res, lim where res <= lim)"""


@query("f10_sigma_cut", f"with {CULL} select chain_id, image_idx, round(u, 4) as u, v, round(res, 6) as res from kept")
def _(t):
    return drop_outliers(residuals(t), "res", 2.0).select("chain_id", "image_idx", r("u", 4).alias("u"), "v", r("res").alias("res"))


@query("f11_two_sided_cut", f"with {RES}, g as (select avg(res) as m, stddev_pop(res) as s from res) select chain_id, image_idx, round(res, 6) as res from res, g where abs(m - res) >= 1.5e0 * s")
def _(t):
    res = residuals(t)
    ends = res.agg(F.avg("res").alias("m"), F.stddev_pop("res").alias("s"))
    return one_row(res, ends).filter(F.abs(F.col("m") - F.col("res")) >= 1.5 * F.col("s")).select("chain_id", "image_idx", r("res").alias("res"))


@query("chain_cull", f"with {CULL}, c as (select chain_id from kept group by chain_id having count(*) >= 30) select chain_id, count(*) as n, round(avg(res), 6) as mean_res from kept where chain_id in (select chain_id from c) group by chain_id")
def _(t):
    """Outliers go, then chains that are left too short."""
    kept = keep_chains(drop_outliers(residuals(t), "res", 2.0), 30)
    return kept.groupBy("chain_id").agg(F.count("*").alias("n"), r(F.avg("res")).alias("mean_res"))


@query("f13_strong_cull", f"with {RES}, lim as (select avg(res) + 2e0 * stddev_pop(res) as lim from res), bad as (select distinct chain_id from res, lim where res > lim) select chain_id, count(*) as n from res where chain_id not in (select chain_id from bad) group by chain_id")
def _(t):
    """Strong mode: a chain with any outlier goes whole."""
    res = residuals(t)
    bad = one_row(res, sigma_limit(res, "res", 2.0)).filter("res > limit").select("chain_id").distinct()
    return res.join(bad, "chain_id", "left_anti").groupBy("chain_id").agg(F.count("*").alias("n"))


@query("f17_weak_images", f"with {CULL}, w as (select image_idx from kept group by image_idx having count(*) < 520) select image_idx, count(*) as n from kept where image_idx in (select image_idx from w) group by image_idx")
def _(t):
    kept = drop_outliers(residuals(t), "res", 2.0)
    return kept.groupBy("image_idx").agg(F.count("*").alias("n")).filter("n < 520")


@query("g05_outlier_rounds", f"""with recursive {RES}, lim(l) as (select max(res) from res union all select x from (select (select avg(res) + 2.5e0 * stddev_pop(res) from res where res <= l) as x, (select max(res) from res where res <= l) as top from lim) where top > x)
select image_idx, count(*) as n, round(max(res), 6) as max_res from res where res <= (select min(l) from lim) group by image_idx""")
def _(t):
    """Recompute, delete, repeat until no residual is above mean + 2.5 sigma."""
    from ..operators.culling import cull_until_stable

    out = cull_until_stable(residuals(t), "res", 2.5)
    return out.groupBy("image_idx").agg(F.count("*").alias("n"), r(F.max("res")).alias("max_res"))


@query("o01_best_matches", f"with {RES}, k as (select *, row_number() over (partition by image_idx order by res, chain_id, u, v) as rn from res) select image_idx, chain_id, rn, round(res, 6) as res from k where rn <= 20")
def _(t):
    w = Window.partitionBy("image_idx").orderBy("res", "chain_id", "u", "v")
    return residuals(t).withColumn("rn", F.row_number().over(w)).filter("rn <= 20").select("image_idx", "chain_id", F.col("rn").cast("long").alias("rn"), r("res").alias("res"))


@query("o03_longest_chains", "select chain_id, count(*) as n from obs group by chain_id order by n desc, chain_id limit 50")
def _(t):
    return t.obs.groupBy("chain_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chain_id").limit(50)


@query("o04_worst_images", f"with {RES}, i as (select image_idx, avg(res) as m from res group by image_idx), g as (select avg(m) + 1e0 * stddev_pop(m) as lim from i) select image_idx, round(m, 6) as m from i, g where m > lim order by m desc, image_idx")
def _(t):
    by = residuals(t).groupBy("image_idx").agg(F.avg("res").alias("m"))
    return one_row(by, sigma_limit(by, "m", 1.0)).filter("m > limit").select("image_idx", r("m").alias("m")).orderBy(F.desc("m"), "image_idx")


@query("o02_work_list", "with p as (select a.image_idx as i, b.image_idx as j, sqrt((a.n-b.n)*(a.n-b.n)+(a.e-b.e)*(a.e-b.e)) as dist from pose a join pose b on b.image_idx between a.image_idx + 1 and a.image_idx + 4) select i, j, cast(round_even(dist / 20, 0) as bigint) as step, round(dist, 6) as dist from p order by step, i, j")
def _(t):
    from ..operators.joins import sequence_pairs

    p = sequence_pairs(t.pose, "image_idx", 4)
    dist = F.hypot(F.col("n") - F.col("n_2"), F.col("e") - F.col("e_2"))
    return p.select(F.col("image_idx").alias("i"), F.col("image_idx_2").alias("j"), F.bround(dist / 20).cast("long").alias("step"), r(dist).alias("dist")).orderBy("step", "i", "j")


@query("o05_image_movement", "with m as (select image_idx, sqrt(n*n + e*e) * (image_idx % 5) / 100e0 as moved from pose) select image_idx, round(moved, 6) as moved from m order by moved, image_idx")
def _(t):
    moved = F.hypot("n", "e") * (F.col("image_idx") % 5) / 100
    return t.pose.select("image_idx", r(moved).alias("moved")).orderBy("moved", "image_idx")


@query("o09_far_images", "with c as (select avg(n) as n0, avg(e) as e0 from pose), d as (select image_idx, sqrt((n-n0)*(n-n0)+(e-e0)*(e-e0)) as dist from pose, c) select count(*) filter (where dist <= 150) as kept, count(*) filter (where dist > 150) as deleted, round(max(dist), 6) as far from d")
def _(t):
    centre = t.pose.agg(F.avg("n").alias("n0"), F.avg("e").alias("e0"))
    d = one_row(t.pose, centre).select(F.hypot(F.col("n") - F.col("n0"), F.col("e") - F.col("e0")).alias("dist"))
    return d.agg(F.count_if(F.col("dist") <= 150).alias("kept"), F.count_if(F.col("dist") > 150).alias("deleted"), r(F.max("dist")).alias("far"))

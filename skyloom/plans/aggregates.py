"""Aggregations (A01-A38) and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins as op
from ..operators import series as ts
from ..operators.grids import fill_bins
from ..operators.pairs import degrees
from .base import query, r


@query("a02_features_per_image", "select count(*) as features, count(distinct image_idx) as images, round(count(*) / count(distinct image_idx)::double, 6) as mean from obs")
def _(t):
    by = t.obs.groupBy("image_idx").count()
    return by.agg(F.sum("count").alias("features"), F.count("*").alias("images"), r(F.sum("count") / F.count("*")).alias("mean"))


@query("a03_chain_position", "select chain_id, round(sum(case when v < 40 then u end) / count(*), 9) as u, round(sum(case when v < 40 then v end) / count(*), 9) as v from obs group by chain_id")
def _(t):
    """Rows above the horizon add nothing but still count."""
    low = F.col("v") < 40
    return t.obs.groupBy("chain_id").agg(*(r(F.sum(F.when(low, F.col(c))) / F.count("*"), 9).alias(c) for c in "uv"))


@query("a04_bounds", "select min(lat_deg) as lat0, max(lat_deg) as lat1, min(lon_deg) as lon0, max(lon_deg) as lon1 from img")
def _(t):
    return t.img.agg(*(f(c).alias(n) for c, n in (("lat_deg", "lat"), ("lon_deg", "lon")) for f, n in ((F.min, f"{n}0"), (F.max, f"{n}1"))))


@query("a06_sentinel", "select p.image_idx, round(coalesce(avg(o.u), 9999e0), 5) as mean, round(coalesce(max(o.u), 9999e0), 5) as largest from pose p left join (select * from obs where u > 900 and v >= 49) o using (image_idx) group by p.image_idx")
def _(t):
    o = t.obs.filter("u > 900 and v >= 49").groupBy("image_idx").agg(F.avg("u").alias("m"), F.max("u").alias("x"))
    return t.pose.select("image_idx").join(o, "image_idx", "left").select("image_idx", r(F.coalesce("m", F.lit(9999.0)), 5).alias("mean"), r(F.coalesce("x", F.lit(9999.0)), 5).alias("largest"))


@query("weighted_surface", "with x as (select l_partkey as id, l_extendedprice / 1e3 as s, l_quantity % 40 as std, l_quantity * l_quantity as w from lineitem) select id, round(sum(case when std < 25 then s * w end) / nullif(sum(case when std < 25 then w end), 0), 1) + 0e0 as surface from x group by id")
def _(t):
    w, s, ok = F.col("l_quantity") * F.col("l_quantity"), F.col("l_extendedprice") / 1e3, F.col("l_quantity") % 40 < 25
    return t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(r(F.sum(F.when(ok, s * w)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0)), 1).alias("surface"))


@query("a11_weighted_yaw", "with x as (select l_suppkey as id, l_discount * 1000 - 50 as yaw, l_quantity as dist, trunc(l_tax * 100 * l_quantity + 1e-9) as w from lineitem) select id, round(sum(yaw * w) / nullif(sum(w), 0), 4) + 0e0 as yaw from x where dist >= 0.5e0 and abs(yaw) <= 30.5e0 group by id")
def _(t):
    x = t.lineitem.select(F.col("l_suppkey").alias("id"), (F.col("l_discount") * 1000 - 50).alias("yaw"), F.col("l_quantity").alias("dist"), (F.col("l_tax") * 100 * F.col("l_quantity") + 1e-9).cast("int").alias("w"))
    return x.filter("dist >= 0.5 and abs(yaw) <= 30.5").groupBy("id").agg(r(F.try_divide(F.sum(F.col("yaw") * F.col("w")), F.sum("w")), 4).alias("yaw"))


@query("a12_online_variance", "select k, round(coalesce(var_samp(x), 0), 5) as var, count(*) as n from series group by k")
def _(t):
    return t.series.groupBy("k").agg(r(F.coalesce(F.var_samp("x"), F.lit(0.0)), 5).alias("var"), F.count("*").alias("n"))


@query("a13_pair_errors", "with d as (select image_idx, u / 10 - v as dx, u / 20 - v as dy from obs) select image_idx, round(sqrt(avg(dx*dx + dy*dy)), 5) as rms, round(var_pop(dx) + var_pop(dy), 4) as var, round(max(sqrt(dx*dx+dy*dy)), 5) as largest from d group by image_idx")
def _(t):
    d = t.obs.select("image_idx", (F.col("u") / 10 - F.col("v")).alias("dx"), (F.col("u") / 20 - F.col("v")).alias("dy"))
    d2 = F.col("dx") ** 2 + F.col("dy") ** 2
    return d.groupBy("image_idx").agg(r(F.sqrt(F.avg(d2)), 5).alias("rms"), r(F.var_pop("dx") + F.var_pop("dy"), 4).alias("var"), r(F.max(F.sqrt(d2)), 5).alias("largest"))


@query("a14_image_error", "with p as (select chain_id, image_idx, count(*) as w, avg(u) as e from obs group by all) select image_idx, round(sqrt((sum(w * e * e) + 100) / (sum(w) + 1)), 5) as err from p group by image_idx")
def _(t):
    p = t.obs.groupBy("chain_id", "image_idx").agg(F.count("*").alias("w"), F.avg("u").alias("e"))
    return p.groupBy("image_idx").agg(r(F.sqrt((F.sum(F.col("w") * F.col("e") * F.col("e")) + 100) / (F.sum("w") + 1)), 5).alias("err"))


@query("a15_intervals", "with d as (select sqrt(power(n - lag(n) over (order by image_idx), 2) + power(e - lag(e) over (order by image_idx), 2)) as d from pose) select round(median(d), 6) as med, round(avg(d), 6) as mean, round(max(d), 6) as largest from d where d is not null")
def _(t):
    """Images in sequence meet the next one by an equi-join, so no single window spans all."""
    p = op.sequence_pairs(t.pose, "image_idx", 1).select(F.hypot(F.col("n") - F.col("n_2"), F.col("e") - F.col("e_2")).alias("d"))
    return p.agg(r(F.median("d")).alias("med"), r(F.avg("d")).alias("mean"), r(F.max("d")).alias("largest"))


@query("a16_group_elevation", "select s_nationkey as grp, round(avg(-d), 6) as mean, round(median(-d), 6) as med, round(stddev_pop(-d), 6) as std from pose join supplier on s_suppkey = image_idx group by s_nationkey")
def _(t):
    p = t.pose.join(t.supplier.select(F.col("s_suppkey").alias("image_idx"), F.col("s_nationkey").alias("grp")), "image_idx").withColumn("z", -F.col("d"))
    return p.groupBy("grp").agg(r(F.avg("z")).alias("mean"), r(F.median("z")).alias("med"), r(F.stddev_pop("z")).alias("std"))


@query("a17_image_elevation", "select p.image_idx, coalesce(sum(v), 0) as total, count(v) as n, coalesce(min(v), 0) as low, coalesce(max(v), 0) as high, round(coalesce(avg(v), 0), 6) as mean from pose p left join (select * from obs where u > 800) o using (image_idx) group by p.image_idx")
def _(t):
    o = t.obs.filter("u > 800").groupBy("image_idx").agg(F.sum("v").alias("total"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    j = t.pose.select("image_idx").join(o, "image_idx", "left")
    return j.select("image_idx", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "low", "high")), F.coalesce("n", F.lit(0)).alias("n"), r(F.coalesce("mean", F.lit(0.0))).alias("mean"))


BINS = "b as (select least(7, floor(n / 37))::bigint as cx, least(7, floor(e / 34))::bigint as cy, -d as z from feat)"


@query("binned_surface", f"with {BINS} select cx, cy, round(avg(z), 6) as mean, count(*) as n from b group by cx, cy")
def _(t):
    return bins(t).select("cx", "cy", r("mean").alias("mean"), "n")


def bins(t):
    cx, cy = F.least(F.lit(7), F.floor(F.col("n") / 37)), F.least(F.lit(7), F.floor(F.col("e") / 34))
    return t.feat.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.avg(-F.col("d")).alias("mean"), F.count("*").alias("n"))


HIST = "h as (select image_idx, least(15, floor(v / 3.2e0))::bigint as bin, count(*)::double as cnt from obs group by all)"


@query("a19_histogram", f"with {HIST}, g as (select image_idx, b.bin from pose, (select unnest(range(16)) as bin) b) select g.image_idx, g.bin, coalesce(cnt, 0) as cnt from g left join h on g.image_idx = h.image_idx and g.bin = h.bin")
def _(t):
    return histogram(t)


def histogram(t):
    """Counts by image and bin, with zeros for empty bins."""
    h = t.obs.groupBy("image_idx", F.least(F.lit(15), F.floor(F.col("v") / 3.2)).alias("bin")).agg(F.count("*").cast("double").alias("cnt"))
    g = t.pose.select("image_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("bin"))
    return g.join(h, ["image_idx", "bin"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0.0)))


@query("histogram_neighbours", f"""
with {HIST}, p as (select a.image_idx as i, b.image_idx as j, 1 / greatest(1e0, sqrt((a.n-b.n)*(a.n-b.n)+(a.e-b.e)*(a.e-b.e))) as w from pose a join pose b on a.image_idx <> b.image_idx and (a.n-b.n)*(a.n-b.n)+(a.e-b.e)*(a.e-b.e) <= 1600),
s as (select i, i as j, 0.1e0 * sum(w) as w from p group by i), q as (select * from p union all select * from s), m as (select i, sum(w) as total from q group by i)
select q.i as image_idx, h.bin, round(sum(h.cnt * q.w) / max(m.total), 5) as cnt from q join h on h.image_idx = q.j join m on m.i = q.i group by q.i, h.bin""")
def _(t):
    """Distance-weighted mean histogram of the images within 40 m, and a tenth of their weight for the own one."""
    p = t.pose.select("image_idx", "n", "e")
    w = op.within(p, p, "n", "e", 40.0).filter("image_idx <> image_idx_2").select(F.col("image_idx").alias("i"), F.col("image_idx_2").alias("j"), (1 / F.greatest(F.lit(1.0), "dist")).alias("w"))
    q = w.unionByName(w.groupBy("i").agg((0.1 * F.sum("w")).alias("w")).withColumn("j", F.col("i")))
    total = q.groupBy("i").agg(F.sum("w").alias("total"))
    h = histogram(t).filter("cnt > 0").withColumnRenamed("image_idx", "j")
    g = q.join(h, "j").groupBy("i", "bin").agg(F.sum(F.col("cnt") * F.col("w")).alias("s"))
    return g.join(total, "i").select(F.col("i").alias("image_idx"), "bin", r(F.col("s") / F.col("total"), 5).alias("cnt"))


@query("hist_cdf", f"with {HIST} select image_idx, bin, round(sum(cnt) over (partition by image_idx order by bin) / sum(cnt) over (partition by image_idx), 6) as cdf from h")
def _(t):
    h = histogram(t).filter("cnt > 0")
    w = Window.partitionBy("image_idx")
    up = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("image_idx", "bin", r(F.sum("cnt").over(up) / F.sum("cnt").over(w)).alias("cdf"))


@query("a21_feature_counts", "select image_idx, count(*) filter (where v <> 13) as n from obs group by image_idx")
def _(t):
    return t.obs.groupBy("image_idx").agg(F.count_if(F.col("v") != 13).alias("n"))


@query("a22_mean_chain_length", "select round(avg(n), 6) as mean from (select chain_id, count(*) as n from obs group by chain_id) z")
def _(t):
    return t.obs.groupBy("chain_id").agg(F.count("*").alias("n")).agg(r(F.avg("n")).alias("mean"))


@query("a23_group_sizes", "select s_nationkey as grp, count(*) as images, count(*) filter (where s_acctbal > 0) as allocated from supplier group by s_nationkey")
def _(t):
    return t.supplier.groupBy(F.col("s_nationkey").alias("grp")).agg(F.count("*").alias("images"), F.count_if(F.col("s_acctbal") > 0).alias("allocated"))


@query("a24_ground_elevation", "with f as (select k, x, row_number() over (partition by k order by t, event_id) as rn from series) select k, round(coalesce(avg(case when x < 5 then x end), min(case when rn = 1 then x end)), 6) as ground from f group by k")
def _(t):
    """Mean of the slow rows, else the first row's value."""
    g = t.series.groupBy("k").agg(F.avg(F.when(F.col("x") < 5, F.col("x"))).alias("m"), F.min(F.struct("t", "event_id", "x")).alias("f"))
    return g.select("k", r(F.coalesce("m", "f.x")).alias("ground"))


@query("a25_gain_ratio", "with c as (select k, sum(abs(x)) as a from series where event_type = 'click' group by k), v as (select k, sum(abs(x)) as b from series where event_type = 'view' group by k) select k, round(a / b, 6) as gain from c join v using (k) where b > 0")
def _(t):
    g = t.series.groupBy("k").agg(*(F.sum(F.when(F.col("event_type") == e, F.abs("x"))).alias(n) for e, n in (("click", "a"), ("view", "b"))))
    return g.filter("a is not null and b > 0").select("k", r(F.col("a") / F.col("b")).alias("gain"))


@query("a26_sample_rate", "select k, cast(round_even(count(*) / (max(t) - min(t)) * 1e6, 0) as bigint) as rate, round(min(t), 3) as t0, round(max(t), 3) as t1 from series group by k having max(t) > min(t)")
def _(t):
    g = t.series.groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).filter("b > a")
    return g.select("k", F.bround(F.col("n") / (F.col("b") - F.col("a")) * 1e6).cast("long").alias("rate"), r("a", 3).alias("t0"), r("b", 3).alias("t1"))


@query("a27_grid_clusters", "select cast(round_even(n / 2, 0) as bigint) as cn, cast(round_even(e / 2, 0) as bigint) as ce, round(avg(n), 6) as n, round(avg(e), 6) as e, count(*) as cnt from feat group by round_even(n / 2, 0), round_even(e / 2, 0)")
def _(t):
    g = t.feat.groupBy(F.bround(F.col("n") / 2).cast("long").alias("cn"), F.bround(F.col("e") / 2).cast("long").alias("ce"))
    return g.agg(r(F.avg("n")).alias("n"), r(F.avg("e")).alias("e"), F.count("*").alias("cnt"))


@query("a28_runway_means", "select o_custkey as id, round(avg(lat), 7) as lat, round(avg(lon), 7) as lon from (select o_custkey, 40 + o_orderkey % 100 / 1e3 as lat, -90 - o_orderkey % 77 / 1e3 as lon from orders) z group by o_custkey")
def _(t):
    x = t.orders.select(F.col("o_custkey").alias("id"), (40 + F.col("o_orderkey") % 100 / 1e3).alias("lat"), (-90 - F.col("o_orderkey") % 77 / 1e3).alias("lon"))
    return x.groupBy("id").agg(r(F.avg("lat"), 7).alias("lat"), r(F.avg("lon"), 7).alias("lon"))


@query("a30_quaternion_mean", "with q as (select s_nationkey as g, cos(s_acctbal / 2e4) as w, sin(s_acctbal / 2e4) as x from supplier), s as (select g, sum(w) as w, sum(x) as x from q group by g) select g, round(w / sqrt(w*w+x*x), 6) + 0e0 as w, round(x / sqrt(w*w+x*x), 6) + 0e0 as x from s")
def _(t):
    a = F.col("s_acctbal") / 2e4
    s = t.supplier.groupBy(F.col("s_nationkey").alias("g")).agg(F.sum(F.cos(a)).alias("w"), F.sum(F.sin(a)).alias("x"))
    n = F.hypot("w", "x")
    return s.select("g", r(F.col("w") / n).alias("w"), r(F.col("x") / n).alias("x"))


@query("a31_line_fit", "select k, round(regr_slope(x, t - 1.7e9), 8) + 0e0 as slope, count(*) as n from series group by k having count(*) >= 3")
def _(t):
    g = t.series.groupBy("k").agg(r(F.regr_slope(F.col("x"), F.col("t") - 1.7e9), 8).alias("slope"), F.count("*").alias("n"))
    return g.filter("n >= 3")


@query("a31_quadratic_fit", """
with s as (select s_nationkey % 5 as g, s_suppkey % 20 - 10e0 as x, s_acctbal as y from supplier),
m as (select g, count(*)::double as n, sum(x) as x1, sum(x*x) as x2, sum(x*x*x) as x3, sum(x*x*x*x) as x4, sum(y) as y0, sum(x*y) as y1, sum(x*x*y) as y2 from s group by g),
d as (select *, n*(x2*x4-x3*x3) - x1*(x1*x4-x2*x3) + x2*(x1*x3-x2*x2) as det from m)
select g, round((n*(x2*y2-x3*y1) - x1*(x1*y2-x2*y1) + y0*(x1*x3-x2*x2)) / det, 4) + 0e0 as a from d where abs(det) > 1e-6""")
def _(t):
    """Leading coefficient by the normal equations: power sums by group and Cramer's rule."""
    s = t.supplier.select((F.col("s_nationkey") % 5).alias("g"), (F.col("s_suppkey") % 20 - 10.0).alias("x"), F.col("s_acctbal").alias("y"))
    x = F.col("x")
    m = s.groupBy("g").agg(F.count("*").cast("double").alias("n"), *(F.sum(x**k).alias(f"x{k}") for k in range(1, 5)), *(F.sum(x**k * F.col("y")).alias(f"y{k}") for k in range(3)))
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    det = n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2)
    return m.withColumn("det", det).filter("abs(det) > 1e-6").select("g", r((n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)) / F.col("det"), 4).alias("a"))


@query("a31_radial_fit", """
with s as (select id % 5 as g, ((u - 2e3) * (u - 2e3) + (v - 1.5e3) * (v - 1.5e3)) / 1e6 as x, id * 37 % 256 * 1e0 as y from uv),
m as (select g, count(*)::double as n, sum(x) as x1, sum(x*x) as x2, sum(x*x*x) as x3, sum(x*x*x*x) as x4, sum(y) as y0, sum(x*y) as y1, sum(x*x*y) as y2 from s group by g),
d as (select *, n*(x2*x4-x3*x3) - x1*(x1*x4-x2*x3) + x2*(x1*x3-x2*x2) as det from m)
select g, round((n*(x2*y2-x3*y1) - x1*(x1*y2-x2*y1) + y0*(x1*x3-x2*x2)) / det, 4) + 0e0 as a, round((n*(y1*x4-x3*y2) - y0*(x1*x4-x2*x3) + x2*(x1*y2-x2*y1)) / det, 4) + 0e0 as b,
  round((y0*(x2*x4-x3*x3) - x1*(y1*x4-x3*y2) + x2*(y1*x3-x2*y2)) / det, 4) + 0e0 as c from d where abs(det) > 1e-6""")
def _(t):
    """The radial model a r^4 + b r^2 + c of brightness by least squares: a parabola in the squared radius, by power sums and Cramer's rule."""
    du, dv = F.col("u") - 2000, F.col("v") - 1500
    s = t.uv.select((F.col("id") % 5).alias("g"), ((du * du + dv * dv) / 1e6).alias("x"), (F.col("id") * 37 % 256 * 1.0).alias("y"))
    x = F.col("x")
    m = s.groupBy("g").agg(F.count("*").cast("double").alias("n"), *(F.sum(x**k).alias(f"x{k}") for k in range(1, 5)), *(F.sum(x**k * F.col("y")).alias(f"y{k}") for k in range(3)))
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    m = m.withColumn("det", n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2)).filter("abs(det) > 1e-6")
    a = n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)
    b = n * (y1 * x4 - x3 * y2) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1)
    c = y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)
    return m.select("g", *(r(v / F.col("det"), 4).alias(k) for k, v in (("a", a), ("b", b), ("c", c))))


VOTE = """m as (select image_idx, floor(u / 100)::bigint as cl, floor(v / 5)::bigint as cr, count(*) as n from obs group by all),
s as (select a.image_idx, a.cl, a.cr, a.n, sum(b.n) as support, count(*) as cells from m a join m b on a.image_idx = b.image_idx and b.cl - a.cl between -1 and 1 and b.cr - a.cr between -1 and 1 group by all)"""


@query("a32_grid_votes", f"with {VOTE} select image_idx, cl, cr, n, support::bigint as support, support > 6 * sqrt(n * 1e0) * sqrt(cells * 1e0) as kept from s")
def _(t):
    """Match voting: a cell pair is kept when its 3 x 3 neighbourhood supports it."""
    m = t.obs.groupBy("image_idx", F.floor(F.col("u") / 100).alias("cl"), F.floor(F.col("v") / 5).alias("cr")).agg(F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    out = m.withColumn("dl", step).withColumn("dr", step).select("image_idx", (F.col("cl") + F.col("dl")).alias("cl"), (F.col("cr") + F.col("dr")).alias("cr"), F.col("n").alias("s"))
    near = out.groupBy("image_idx", "cl", "cr").agg(F.sum("s").alias("support"), F.count("*").alias("cells"))
    j = m.join(near, ["image_idx", "cl", "cr"])
    return j.select("image_idx", "cl", "cr", "n", "support", (F.col("support") > 6 * F.sqrt(F.col("n").cast("double")) * F.sqrt(F.col("cells").cast("double"))).alias("kept"))


@query("a33_mean_image", "select u::bigint % 40 as x, v::bigint % 30 as y, round(avg(id % 256), 6) as mean, round(var_pop(id % 256), 5) as var from uv group by all")
def _(t):
    z = F.col("id") % 256
    return t.uv.groupBy((F.col("u").cast("long") % 40).alias("x"), (F.col("v").cast("long") % 30).alias("y")).agg(r(F.avg(z)).alias("mean"), r(F.var_pop(z), 5).alias("var"))


@query("a34_cell_medians", "select floor(u / 500)::bigint as cx, floor(v / 500)::bigint as cy, median(u) as mu, median(v) as mv from uv group by all")
def _(t):
    return t.uv.groupBy(F.floor(F.col("u") / 500).alias("cx"), F.floor(F.col("v") / 500).alias("cy")).agg(F.median("u").alias("mu"), F.median("v").alias("mv"))


@query("a35_degrees", "with e as (select distinct l_suppkey as i, l_partkey as c from lineitem), w as (select a.i, b.i as j, count(*) as w from e a join e b on a.c = b.c and a.i <> b.i group by all) select i, count(*) as degree, sum(w)::bigint as weight from w group by i")
def _(t):
    return degrees(t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("c")), "c", "i")


@query("a36_affine_mean", "select a.image_idx as i, round(sum(b.n * (b.image_idx % 7 + 1)) / sum(b.image_idx % 7 + 1), 6) + 0e0 as n, round(sum(b.e * (b.image_idx % 7 + 1)) / sum(b.image_idx % 7 + 1), 6) + 0e0 as e from pose a join pose b on b.image_idx between a.image_idx + 1 and a.image_idx + 4 group by a.image_idx")
def _(t):
    p = op.sequence_pairs(t.pose, "image_idx", 4).withColumn("w", F.col("image_idx_2") % 7 + 1)
    mean = lambda c: r(F.sum(F.col(c) * F.col("w")) / F.sum("w"))
    return p.groupBy(F.col("image_idx").alias("i")).agg(mean("n_2").alias("n"), mean("e_2").alias("e"))


@query("a37_split_points", "with k as (select c_nationkey as g, c_acctbal as x, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as rn, count(*) over (partition by c_nationkey) as n from customer) select g, x, rn from k where rn - 1 in (n // 4, 2 * (n // 4), 3 * (n // 4))")
def _(t):
    w = Window.partitionBy("g")
    k = t.customer.select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), "c_custkey")
    k = k.withColumns({"rn": F.row_number().over(w.orderBy("x", "c_custkey")).cast("long"), "q": F.floor(F.count("*").over(w) / 4)})
    return k.filter("rn - 1 in (q, 2 * q, 3 * q)").select("g", "x", "rn")


@query("series_rates", "select k, event_id, round(coalesce((x - lag(x) over w) / nullif(t - lag(t) over w, 0), 0), 8) + 0e0 as rate from series window w as (partition by k order by t, event_id)")
def _(t):
    return ts.rates(t.series.select("k", "event_id", "t", "x"), ["k"], "t", "x", ["t", "event_id"]).select("k", "event_id", r("rate", 8).alias("rate"))


@query("w02_heading_blend", """
with a as (select image_idx, n, e, lag(n) over w as pn, lag(e) over w as pe, lead(n) over w as nn, lead(e) over w as ne, (image_idx - 1) // 10 as line from pose window w as (partition by (image_idx - 1) // 10 order by image_idx)),
b as (select image_idx, coalesce(n - pn, 0) as an, coalesce(e - pe, 0) as ae, coalesce(nn - n, 0) as bn, coalesce(ne - e, 0) as be from a)
select image_idx, round((degrees(atan2(ae + be, an + bn)) % 360 + 360) % 360, 5) + 0e0 as heading from b""")
def _(t):
    """Heading of the ground track along each line: displacement before and after, each with its length as weight."""
    from ..functions.angles import course

    w = Window.partitionBy(F.floor((F.col("image_idx") - 1) / 10)).orderBy("image_idx")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = {f"a{c}": zero(F.col(c) - F.lag(c).over(w)) for c in "ne"} | {f"b{c}": zero(F.lead(c).over(w) - F.col(c)) for c in "ne"}
    p = t.pose.withColumns(d)
    return p.select("image_idx", r(course(F.col("an") + F.col("bn"), F.col("ae") + F.col("be")), 5).alias("heading"))


@query("w03_ewma", """
with recursive o as (select k, event_id, x, row_number() over (partition by k order by t, event_id) as rn from series),
y as (select k, event_id, rn, x as ewma from o where rn = 1 union all select o.k, o.event_id, o.rn, 0.2e0 * o.x + 0.8e0 * y.ewma from y join o on o.k = y.k and o.rn = y.rn + 1)
select k, event_id, round(ewma, 6) as ewma from y""")
def _(t):
    s = t.series.select("k", "event_id", "x")
    return ts.ewma(s, ["k"], "event_id", "x", 0.2).select("k", "event_id", r("ewma").alias("ewma"))


@query("w03_trailing_ewma", "select k, event_id, round(sum(c * x) / sum(c), 6) as ewma from (select a.k, a.event_id, b.x, power(0.8e0, a.rn - b.rn) as c from (select *, row_number() over (partition by k order by t, event_id) as rn from series) a join (select *, row_number() over (partition by k order by t, event_id) as rn from series) b on a.k = b.k and b.rn between a.rn - 11 and a.rn) z group by all")
def _(t):
    s = t.series.select("k", "event_id", "t", "x")
    return ts.trailing_ewma(s, ["k"], ["t", "event_id"], "x", 0.2, 12).select("k", "event_id", r("ewma").alias("ewma"))


@query("w04_leaky_sum", "with recursive o as (select k, event_id, x, row_number() over (partition by k order by t, event_id) as rn from series), y as (select k, event_id, rn, x as leaky from o where rn = 1 union all select o.k, o.event_id, o.rn, o.x + 0.95e0 * y.leaky from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round(leaky + 3e-8, 5) as leaky from y")
def _(t):
    """acc = 0.95 acc + x is the smoothing with k = 0.05 of the values scaled by 20, but for its start.

    Exact halves of the last digit are moved up before rounding, in the SQL as well.
    """
    w = Window.partitionBy("k").orderBy("event_id")
    s = t.series.select("k", "event_id", "x", F.when(F.row_number().over(w) == 1, F.col("x")).otherwise(F.col("x") * 20).alias("y"))
    return ts.ewma(s, ["k"], "event_id", "y", 0.05).select("k", "event_id", r(F.col("ewma") + 3e-8, 5).alias("leaky"))


@query("w06_cumulative", "select k, event_id, round(sum(x) over (partition by k order by t, event_id rows unbounded preceding), 4) as total from series")
def _(t):
    w = Window.partitionBy("k").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.series.select("k", "event_id", r(F.sum("x").over(w), 4).alias("total"))


@query("w07_resample", """
with s as (select k, t, min(x) as x from series group by k, t), g as (select k, min(t) as t0, max(t) as t1, greatest(1, round_even((max(t) - min(t)) / 43200, 0)::bigint) as n from s group by k),
q as (select k, i, t0 + (t1 - t0) * i / n as t from (select *, unnest(range(n)) as i from g) z),
a as (select q.k, q.i, q.t, s.t as ta, s.x as xa from q asof left join s on q.k = s.k and q.t >= s.t), b as (select q.k, q.i, s.t as tb, s.x as xb from q asof left join s on q.k = s.k and q.t <= s.t)
select a.k, a.i, round(coalesce(case when ta = tb then xa else xa + (xb - xa) * (t - ta) / (tb - ta) end, 0), 4) as x from a join b on a.k = b.k and a.i = b.i""")
def _(t):
    return ts.resample(t.series.select("k", "t", "x"), ["k"], "t", "x", 1 / 43200).select("k", "i", r("x_at", 4).alias("x"))


@query("w08_first_wins", "with k as (select chain_id, image_idx, u, v, row_number() over (partition by image_idx, floor(u / 10) order by u, v, chain_id) as rn from obs) select image_idx, chain_id, round(u, 4) as u, v from k where rn = 1")
def _(t):
    w = Window.partitionBy("image_idx", F.floor(F.col("u") / 10)).orderBy("u", "v", "chain_id")
    return t.obs.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("image_idx", "chain_id", r("u", 4).alias("u"), "v")


@query("w09_group_argmin", "with k as (select chain_id, image_idx, v, row_number() over (partition by chain_id order by v, image_idx, u) as rn from obs) select chain_id, image_idx, v from k where rn = 1")
def _(t):
    return t.obs.groupBy("chain_id").agg(F.min(F.struct("v", "image_idx")).alias("m")).select("chain_id", "m.image_idx", "m.v")


@query("w10_last_state", "select k, event_id, coalesce(last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by k order by t, event_id rows unbounded preceding), -1) as state from series")
def _(t):
    w = Window.partitionBy("k").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return t.series.select("k", "event_id", F.coalesce(last, F.lit(-1)).alias("state"))


@query("w11_butterworth")
def _(t):
    """Zero-phase smoothing; compared with a frequency response and symmetry in the tests."""
    s = t.series.select("k", "event_id", "x")
    return ts.smooth(s, ["k"], "event_id", "x", 0.2).select("k", "event_id", r("smooth").alias("smooth"))


@query("xcorr_shift", """
with g as (select event_type as k, floor(t / 21600)::bigint as i, sum(x) - 100 as x from series group by all),
a as (select * from g where k = 'click'), j as (select b.k, b.i - a.i as lag, sum(a.x * b.x) as score from a join g b on b.i - a.i between -8 and 8 group by all),
n as (select *, row_number() over (partition by k order by round(score, 6) desc, lag) as rn from j) select k, lag, round(score, 3) as score from n where rn = 1""")
def _(t):
    """The lag at which each kind of series agrees best with the clicks."""
    g = t.series.groupBy(F.col("event_type").alias("k"), F.floor(F.col("t") / 21600).alias("i")).agg((F.sum("x") - 100).alias("x"))
    a = g.filter("k = 'click'").select("i", "x").crossJoin(g.select("k").distinct())
    return ts.best_lag(a, g, ["k"], 8).select("k", F.col("lag").cast("long").alias("lag"), r("score", 3).alias("score"))


@query("w13_fill_missing", """
with z as (select image_idx as i, 1 as k, case when image_idx % 4 = 0 then null else n end as n from pose), s as (select * from z where n is not null),
a as (select z.i, s.i as ia, s.n as na from z asof left join s on z.k = s.k and z.i >= s.i), b as (select z.i, s.i as ib, s.n as nb from z asof left join s on z.k = s.k and z.i <= s.i)
select a.i, round(coalesce(case when ia = ib then na else na + (nb - na) * (a.i - ia) / (ib - ia) end, na, nb, 0), 6) as n from a join b using (i)""")
def _(t):
    """Missing values along the index, beyond the ends the last known one."""
    z = t.pose.select(F.col("image_idx").alias("i"), F.when(F.col("image_idx") % 4 != 0, F.col("n")).alias("n"))
    return ts.fill_along(z, "i", "n").select(F.col("i").cast("long").alias("i"), r("n_at").alias("n"))


@query("w14_draw_offset", "select image_idx, round(-0.01e0 * (row_number() over (partition by image_idx % 4 order by d, image_idx) - 1), 6) + 0e0 as depth from pose")
def _(t):
    w = Window.partitionBy(F.col("image_idx") % 4).orderBy("d", "image_idx")
    return t.pose.select("image_idx", r(-0.01 * (F.row_number().over(w) - 1)).alias("depth"))


@query("trailing_mean", "with s as (select *, row_number() over (partition by k, floor(t / 3600) order by t, event_id) as rn from series), o as (select * from s where rn = 1) select k, event_id, round(avg(x) over (partition by k order by t, event_id rows 4 preceding), 6) as mean from o")
def _(t):
    """First row of each hour, then the mean of the last five."""
    first = Window.partitionBy("k", F.floor(F.col("t") / 3600)).orderBy("t", "event_id")
    w = Window.partitionBy("k").orderBy("t", "event_id").rowsBetween(-4, 0)
    return t.series.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("k", "event_id", r(F.avg("x").over(w)).alias("mean"))


@query("active_events", "select k, event_id, count(*) over (partition by k order by t range between 86400 preceding and current row) as n, round(sum(x) over (partition by k order by t range between 86400 preceding and current row), 4) as total from series")
def _(t):
    """Events of the last day at each event."""
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-86400, 0)
    return t.series.select("k", "event_id", F.count("*").over(w).alias("n"), r(F.sum("x").over(w), 4).alias("total"))


@query("o07_best_view", "with m as (select f.chain_id, p.image_idx, sqrt((f.n-p.n)*(f.n-p.n)+(f.e-p.e)*(f.e-p.e)) + 0.1e0 * (p.image_idx % 9) + case when abs(f.n-p.n) > 100 then 1000 else 0 end as metric from feat f, pose p), k as (select *, row_number() over (partition by chain_id order by round(metric, 6), image_idx) as rn from m) select chain_id, image_idx, round(metric, 6) as metric from k where rn = 3")
def _(t):
    """The third best view of each point: the metric is never below the distance, so far views are not formed."""
    f = t.feat.select("chain_id", "n", "e")
    views = t.pose.select("image_idx", "n", "e")
    aside = F.when(F.abs(F.col("n") - F.col("n_2")) > 100, 1000).otherwise(0)
    metric = F.round(F.col("dist") + 0.1 * (F.col("image_idx_2") % 9) + aside, 6)
    best = op.nearest(f, views, "chain_id", "image_idx", "n", "e", 30.0, k=3, metric=metric)
    return best.filter("rank = 3").select("chain_id", F.col("image_idx_2").alias("image_idx"), r("metric").alias("metric"))


#: Bins that are emptied first, so that several rounds are due; seven rounds reach every bin of an 8 x 8 grid.
HOLE = "cx between 2 and 6 and cy between 2 and 6"
FILL = f"r0 as (select cx, cy, avg(z) as mean, count(*)::bigint as n from b where not ({HOLE}) group by cx, cy)" + "".join(
    f""", r{k + 1} as materialized (select * from r{k} union all select g.x as cx, g.y as cy, sum(q.mean * q.n) / sum(q.n) as mean, floor(sum(q.n) / count(*)::double)::bigint as n
    from (select x.i as x, y.i as y from (select unnest(range(8)) as i) x, (select unnest(range(8)) as i) y) g
    join r{k} q on q.cx between g.x - 1 and g.x + 1 and q.cy between g.y - 1 and g.y + 1
    where not exists (select 1 from r{k} o where o.cx = g.x and o.cy = g.y) group by g.x, g.y having sum(q.n) > 0)"""
    for k in range(7)
)


@query("binned_fill", f"with {BINS}, {FILL} select cx, cy, round(mean, 6) as mean, n from r7")
def _(t):
    """Empty bins take the count-weighted mean of their 3 x 3 neighbours, round by round until none is left."""
    full = fill_bins(bins(t).filter(f"not ({HOLE})"), 8, 8)
    return full.select("cx", "cy", r("mean").alias("mean"), "n")

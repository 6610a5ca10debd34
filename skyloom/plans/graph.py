"""Chains, groups and estimators (G01-G11, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import estimators as est
from ..operators import graph as op
from ..operators.fitting import grid_search
from ..operators.grids import ray_surface
from ..operators.joins import nearest, sequence_pairs
from ..operators.pairs import pair_counts
from ..operators.ranks import ranked, tiles
from ..sources.terrain import bilinear
from .base import query, r
from .joins import DESC, descriptor_pairs


def pairs_of(t):
    """Keypoint pairs of image pairs from the orders: small graphs with shared keypoints."""
    o = F.col("o_orderkey")
    return t.orders.select(o.alias("ord"), (o % 40).alias("image_i"), (o * 7 % 60).alias("kp_i"), (o * 3 % 41).alias("image_j"), (o * 11 % 60).alias("kp_j"))


@query("g01_direct_chains", "select o_orderkey as ord, o_orderkey % 40 as image_i, o_orderkey * 7 % 60 as kp_i, o_orderkey * 3 % 41 as image_j, o_orderkey * 11 % 60 as kp_j from orders where o_orderkey % 40 < o_orderkey * 3 % 41")
def _(t):
    return op.direct_chains(pairs_of(t))


@query("g02_link_chains")
def _(t):
    """Linked chains by component; the tests hold it against one global replay."""
    c = op.link_chains(op.direct_chains(pairs_of(t)))
    return c.groupBy("chain").agg(F.count("*").alias("n"), F.min("image").alias("first"), F.max("image").alias("last"))


EDGES = "e as (select s_suppkey as a, s_suppkey * 7 % 31 + 1 as b from supplier where s_suppkey % 3 <> 0)"


@query("chain_components", f"with recursive {EDGES}, u as (select a, b from e union select b, a from e), w as (select a as id, a as c from u union select u.b, w.c from w join u on u.a = w.id) select id, min(c) as component from w group by id")
def _(t):
    e = t.supplier.filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 31 + 1).alias("b"))
    return op.components(e)


@query("g03_image_groups")
def _(t):
    """Groups by saturating growth; the tests hold it against a plain restatement.

    Image ids are made dense for the growth, by ranks that no single task computes.
    """
    o = t.lineitem.select(F.col("l_partkey").alias("chain"), F.col("l_suppkey").alias("id")).distinct()
    ids = ranked(o.select("id").distinct(), ["id"], "rank").select("id", (F.col("rank") - 1).alias("image"))
    o = o.join(ids, "id").select("chain", "image").withColumn("pos", F.row_number().over(Window.partitionBy("chain").orderBy("image")))
    return op.image_groups(o, ids.count()).join(ids, "image").select("group_id", F.col("id").alias("image"))


@query("g07_neighbour_slopes", """
with d as (select a.chain_id, b.d - a.d as dz, sqrt((a.n-b.n)*(a.n-b.n)+(a.e-b.e)*(a.e-b.e)) as dist, b.chain_id as other from feat a join feat b on a.chain_id <> b.chain_id),
k as (select *, row_number() over (partition by chain_id order by dist, other) as rn from d where dist > 0) select chain_id, round(avg(abs(dz / dist)), 5) as slope from k where rn <= 4 group by chain_id""")
def _(t):
    """Mean slope to the four nearest features apart from the own place.

    Neighbours are sought once for each place; of the features of a place no more than the four first can be among them.
    """
    first = Window.partitionBy("n", "e").orderBy("chain_id")
    f = t.feat.withColumn("rn", F.row_number().over(first)).filter("rn <= 4").drop("rn")
    places = t.feat.groupBy("n", "e").agg(F.min("chain_id").alias("place"))
    apart = F.when(F.col("dist") > 0, F.col("dist")).otherwise(float("inf"))
    near = nearest(places, f, "place", "chain_id", "n", "e", 20.0, k=4, metric=apart).filter("dist > 0")
    k = t.feat.join(near.select("n", "e", "d_2", "dist"), ["n", "e"])
    return k.groupBy("chain_id").agg(r(F.avg(F.abs((F.col("d_2") - F.col("d")) / F.col("dist"))), 5).alias("slope"))


@query("g08_neighbour_regression", "with d as (select a.image_idx as i, sqrt(power(a.n-b.n,2)+power(a.e-b.e,2)) as d2, sqrt(power(a.n-b.n,2)+power(a.e-b.e,2)+power(a.d-b.d,2)) as d3 from pose a join pose b on b.image_idx between a.image_idx + 1 and a.image_idx + 8), f as (select i, regr_slope(d3, d2) as s, regr_intercept(d3, d2) as c from d group by i having count(*) >= 3) select d.i, round(avg(abs(d3 - s * d2 - c)), 5) as res from d join f on d.i = f.i group by d.i")
def _(t):
    """Distance in space against distance in the plane among neighbours: mean residual of the line, by image."""
    p = sequence_pairs(t.pose, "image_idx", 8)
    d2 = (F.col("n") - F.col("n_2")) ** 2 + (F.col("e") - F.col("e_2")) ** 2
    d = p.select(F.col("image_idx").alias("i"), F.sqrt(d2).alias("d2"), F.sqrt(d2 + (F.col("d") - F.col("d_2")) ** 2).alias("d3"))
    f = d.groupBy("i").agg(F.regr_slope("d3", "d2").alias("s"), F.regr_intercept("d3", "d2").alias("c"), F.count("*").alias("m")).filter("m >= 3")
    return d.join(f, "i").groupBy("i").agg(r(F.avg(F.abs(F.col("d3") - F.col("s") * F.col("d2") - F.col("c"))), 5).alias("res"))


@query("g09_spatial_cells", "with a as (select chain_id, n, e, ntile(4) over (order by n, chain_id) as tn from feat) select chain_id, tn::bigint as tn, ntile(4) over (partition by tn order by e, chain_id)::bigint as te from a")
def _(t):
    """Near-equal cells: quarters by north, each in quarters by east, by ranks that no single task computes."""
    a = tiles(t.feat.select("chain_id", "n", "e"), None, ["n", "chain_id"], 4, "tn")
    return tiles(a, "tn", ["e", "chain_id"], 4, "te").select("chain_id", "tn", "te")


@query("g10_connectivity", "with o as (select distinct chain_id, image_idx from obs) select distinct x.name as a, y.name as b from o p join o q on p.chain_id = q.chain_id and p.image_idx < q.image_idx join img x on x.image_idx = p.image_idx join img y on y.image_idx = q.image_idx")
def _(t):
    p = pair_counts(t.obs, "chain_id", "image_idx")
    name = t.img.select("image_idx", "name")
    named = p.join(name.toDF("i", "a"), "i").join(name.toDF("j", "b"), "j").select("a", "b")
    # pairs of images are distinct, so pairs of names repeat only where images or names do
    n = name.agg(F.count("*").alias("n"), F.count("name").alias("named"), F.countDistinct("image_idx").alias("images"), F.countDistinct("name").alias("names")).first()
    return named if n["n"] == n["named"] == n["images"] == n["names"] else named.distinct()


@query("g11_delete_image", "with o as (select distinct chain_id, image_idx from obs where image_idx not in (7, 8, 9)), c as (select chain_id from o group by chain_id having count(*) >= 25) select chain_id, image_idx from o where chain_id in (select chain_id from c)")
def _(t):
    from ..operators.culling import keep_chains

    o = t.obs.filter(~F.col("image_idx").isin(7, 8, 9)).select("chain_id", "image_idx").distinct()
    return keep_chains(o, 25).select("chain_id", "image_idx")


LINES = """a as (select o.chain_id, p.n as px, p.e as py, p.d as pz, f.n + o.image_idx % 3 - p.n as vx, f.e + o.image_idx % 5 - p.e as vy, f.d - p.d as vz from (select distinct chain_id, image_idx from obs) o join pose p using (image_idx) join feat f using (chain_id)),
b as (select *, vx*vx+vy*vy+vz*vz as n2 from a), c as (select chain_id, px, py, pz, 1-vx*vx/n2 as a00, -vx*vy/n2 as a01, -vx*vz/n2 as a02, 1-vy*vy/n2 as a11, -vy*vz/n2 as a12, 1-vz*vz/n2 as a22 from b),
s as (select chain_id, sum(a00) as a, sum(a01) as b, sum(a02) as c, sum(a11) as d, sum(a12) as e, sum(a22) as f, sum(a00*px+a01*py+a02*pz) as x, sum(a01*px+a11*py+a12*pz) as y, sum(a02*px+a12*py+a22*pz) as z from c group by chain_id),
m as (select *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) as det from s)"""


@query("ray_intersection", f"with {LINES} select chain_id, round((x*(d*f-e*e) - b*(y*f-e*z) + c*(y*e-d*z)) / det, 4) + 0e0 as x, round((a*(y*f-e*z) - x*(b*f-c*e) + c*(b*z-c*y)) / det, 4) + 0e0 as y, round((a*(d*z-e*y) - b*(b*z-c*y) + x*(b*e-c*d)) / det, 4) + 0e0 as z from m where abs(det) > 1e-9")
def _(t):
    """The point nearest to all rays of a chain."""
    f = t.feat.toDF("chain_id", "fn", "fe", "fd")
    o = t.obs.select("chain_id", "image_idx").distinct().join(t.pose, "image_idx").join(f, "chain_id")
    rays = o.select("chain_id", F.col("n").alias("px"), F.col("e").alias("py"), F.col("d").alias("pz"), (F.col("fn") + F.col("image_idx") % 3 - F.col("n")).alias("vx"), (F.col("fe") + F.col("image_idx") % 5 - F.col("e")).alias("vy"), (F.col("fd") - F.col("d")).alias("vz"))
    x = est.ray_intersection(rays, "chain_id").filter("x is not null")
    return x.select("chain_id", *(r(c, 4).alias(c) for c in "xyz"))


@query("e08_similarity_fit", """
with p as (select p_size as g, (p_partkey * 7919 % 4000) * 1e0 as x, (p_partkey * 104729 % 3000) * 1e0 as y, 0.9e0 * (p_partkey * 7919 % 4000) - 0.2e0 * (p_partkey * 104729 % 3000) + p_partkey % 7 as u, 0.2e0 * (p_partkey * 7919 % 4000) + 0.9e0 * (p_partkey * 104729 % 3000) + p_partkey % 5 as v from part),
s as (select g, count(*) as n, sum(x) as sx, sum(y) as sy, sum(u) as su, sum(v) as sv, sum(x*x+y*y) as q, sum(x*u+y*v) as dt, sum(x*v-y*u) as cr from p group by g),
k as (select g, (dt - (sx*su+sy*sv)/n) / nullif(q - (sx*sx+sy*sy)/n, 0) as a, (cr - (sx*sv-sy*su)/n) / nullif(q - (sx*sx+sy*sy)/n, 0) as b from s)
select g, round(degrees(atan2(b, a)), 5) + 0e0 as rotation, round(sqrt(a*a+b*b), 6) as scale from k where a is not null""")
def _(t):
    x, y = (F.col("p_partkey") * 7919 % 4000) * 1.0, (F.col("p_partkey") * 104729 % 3000) * 1.0
    p = t.part.select(F.col("p_size").alias("g"), x.alias("x"), y.alias("y"), (0.9 * x - 0.2 * y + F.col("p_partkey") % 7).alias("u"), (0.2 * x + 0.9 * y + F.col("p_partkey") % 5).alias("v"))
    return est.similarity_fit(p, "g").filter("scale is not null").select("g", r("rotation", 5).alias("rotation"), r("scale").alias("scale"))


@query("e09_surface_estimate", "select image_idx, round(-avg(feat.d), 5) as surface, round(stddev_pop(feat.d), 5) as std, count(*) as n from obs join feat using (chain_id) group by image_idx")
def _(t):
    d = t.obs.join(t.feat.select("chain_id", "d"), "chain_id")
    return d.groupBy("image_idx").agg(r(-F.avg("d"), 5).alias("surface"), r(F.stddev_pop("d"), 5).alias("std"), F.count("*").alias("n"))


@query("e10_yaw_error", """
with p as (select a.image_idx as i, b.image_idx as j, b.n - a.n as dn, b.e - a.e as de, (a.image_idx * 37 % 360) * 1e0 as yaw from pose a join pose b on b.image_idx between a.image_idx + 1 and a.image_idx + 4),
q as (select i, sqrt(dn*dn+de*de) as dist, (((degrees(atan2(de, dn)) - yaw + 180) % 360) + 360) % 360 - 180 as err from p) select i, round(sum(err * trunc(dist)) / sum(trunc(dist)), 4) + 0e0 as yaw_error, count(*) as n from q where dist >= 0.5e0 group by i""")
def _(t):
    """Course made good against heading over a pair's displacement, weighted by whole metres."""
    from ..functions.angles import course, wrap_180

    p = sequence_pairs(t.pose, "image_idx", 4)
    dn, de = F.col("n_2") - F.col("n"), F.col("e_2") - F.col("e")
    q = p.select(F.col("image_idx").alias("i"), F.hypot(dn, de).alias("dist"), wrap_180(course(dn, de) - F.col("image_idx") * 37 % 360).alias("err")).filter("dist >= 0.5")
    w = F.col("dist").cast("int")
    return q.groupBy("i").agg(r(F.sum(F.col("err") * w) / F.sum(w), 4).alias("yaw_error"), F.count("*").alias("n"))


@query("e16_bilinear", """
with g as (select unnest(range(12)) as i), h as (select unnest(range(12)) as j), z as (select i, j, (i * 7 + j * 13) % 29 * 1e0 as z from g, h), p as (select image_idx, n / 30 as x, e / 30e0 as y from pose),
q as (select image_idx, x + 0.25e0 as x, y + 0.5e0 as y, floor(x + 0.25e0)::bigint as i, floor(y + 0.5e0)::bigint as j from p)
select image_idx, round(coalesce((1-(x-q.i))*(1-(y-q.j))*a.z + (x-q.i)*(1-(y-q.j))*b.z + (1-(x-q.i))*(y-q.j)*c.z + (x-q.i)*(y-q.j)*d.z, -32768e0), 5) as z from q left join z a on a.i = q.i and a.j = q.j left join z b on b.i = q.i + 1 and b.j = q.j left join z c on c.i = q.i and c.j = q.j + 1 left join z d on d.i = q.i + 1 and d.j = q.j + 1""")
def _(t):
    i = t.spark.range(12).toDF("i")
    grid = i.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")))).withColumn("z", ((F.col("i") * 7 + F.col("j") * 13) % 29) * 1.0)
    p = t.pose.select("image_idx", (F.col("n") + 7.5).alias("x"), (F.col("e") + 15).alias("y"))
    return bilinear(p, grid, "x", "y", 30.0).select("image_idx", r("z", 5).alias("z"))


CORNERS = " + ".join(
    f"case when {wx} * {wy} = 0 then 0 else {wx} * {wy} * {c}.z end"
    for c, wx, wy in (("a", "(1 - fx)", "(1 - fy)"), ("b", "fx", "(1 - fy)"), ("c", "(1 - fx)", "fy"), ("d", "fx", "fy"))
)
GROUND = """(select *, x / 30e0 - i as fx, y / 30e0 - j as fy from (select *, floor(x / 30e0)::bigint as i, floor(y / 30e0)::bigint as j from {}) w) q
left join g a on a.i = q.i and a.j = q.j left join g b on b.i = q.i + 1 and b.j = q.j left join g c on c.i = q.i and c.j = q.j + 1 left join g d on d.i = q.i + 1 and d.j = q.j + 1"""


@query("e15_ray_surface", f"""
with recursive g as (select i, j, sin(i / 5e0) * 10 + cos(j / 7e0) * 8 as z from (select unnest(range(40)) as i) x, (select unnest(range(40)) as j) y),
s as (select image_idx, n, e, down, x, y, h, coalesce({CORNERS}, 0e0) as ground, 0 as k from {GROUND.format("(select image_idx, n, e, d as down, n as x, e as y, d * 1e0 as h from pose) v")}
union all select image_idx, n, e, down, x, y, h, coalesce({CORNERS}, was) as ground, k + 1 from
{GROUND.format("(select image_idx, n, e, down, n + 0.3e0 * -(down + ground) as x, e + 0.2e0 * -(down + ground) as y, -ground as h, ground as was, k from s where abs(h + ground) > 0.01e0 and k < 25) v")}),
l as (select *, row_number() over (partition by image_idx order by k desc) as rn from s)
select image_idx, round(x, 4) + 0e0 as x, round(y, 4) + 0e0 as y, round(h, 4) + 0e0 as z from l where rn = 1""")
def _(t):
    """Camera rays against a terrain grid (E15): the height under the last place sets the next level, 25 steps at most."""
    i = t.spark.range(40).toDF("i")
    grid = i.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))).withColumn("z", F.sin(F.col("i") / 5.0) * 10 + F.cos(F.col("j") / 7.0) * 8)
    rays = t.pose.select("image_idx", "n", "e", "d", F.lit(0.3).alias("vn"), F.lit(0.2).alias("ve"), F.lit(1.0).alias("vd"))
    return ray_surface(rays, grid, 30.0).select("image_idx", *(r(c, 4).alias(c) for c in "xyz"))


@query("a29_quaternion_average")
def _(t):
    from .scalar import quat_of

    q = quat_of(t.img.withColumn("grp", F.col("image_idx") % 7))
    out = est.quaternion_average(q, "grp")
    return out.select("grp", *(r(c).alias(c) for c in ("qw", "qx", "qy", "qz")))


@query("e13_refit", "select image_idx, round(n, 4) + 0e0 as n, round(e, 4) + 0e0 as e, round(d, 4) + 0e0 as d from pose")
def _(t):
    """Positions moved by a known similarity and fitted back, which gives the positions themselves."""
    c, s = 0.96, 0.28
    moved = t.pose.select("image_idx", *(F.col(x).alias(f"t{x}") for x in "ned"), (1.1 * (c * F.col("n") - s * F.col("e")) + 5).alias("n"), (1.1 * (s * F.col("n") + c * F.col("e")) - 3).alias("e"), (1.1 * F.col("d") + 2).alias("d"))
    out, _ = est.refit(moved, ("n", "e", "d"), ("tn", "te", "td"))
    return out.select("image_idx", *(r(f"{x}_fit", 4).alias(x) for x in "ned"))


@query("e18_polynomial_surface")
def _(t):
    f = t.feat.select((F.col("n") / 300).alias("x"), (F.col("e") / 300).alias("y"), (-F.col("d")).alias("z"))
    c = est.polynomial_surface(f, "x", "y", "z", 3)
    return t.spark.createDataFrame([(i, j, round(float(c[i, j]), 4)) for i in range(4) for j in range(4)], "i int, j int, c double")


@query("e04_ratio_bins", f"with {DESC}, g as (select i, min(case when rn = 1 then d end) / min(case when rn = 2 then d end) as ratio from k where rn <= 2 group by i) select bin, count(*) filter (where ratio < bin) as n from g, (select unnest(range(10, 20)) / 20e0 as bin) b group by bin")
def _(t):
    """Cumulative counts of matches by distance ratio, in steps of 0.05 from 0.5 to 0.85."""
    g = descriptor_pairs(t).groupBy("i").agg((F.min(F.when(F.col("rn") == 1, F.col("d"))) / F.min(F.when(F.col("rn") == 2, F.col("d")))).alias("ratio"))
    cut = F.explode(F.transform(F.sequence(F.lit(10), F.lit(19)), lambda k: k / 20.0))
    return g.withColumn("bin", cut).groupBy("bin").agg(F.count_if(F.col("ratio") < F.col("bin")).alias("n"))


@query("e05_overlapping_bins", """
with b as (select image_idx, floor(sqrt(u * u + v * v) / 100)::bigint as d, floor(degrees(atan2(v, u)) + 1e-9)::bigint as a from obs), n as (select image_idx, d, a, count(*) as m from b group by all),
c as (select image_idx, d + x as dist, a + y as angle, sum(m)::bigint as n from n, (select unnest([-1, 0, 1]) as x), (select unnest([-1, 0, 1]) as y) group by all),
k as (select *, row_number() over (partition by image_idx order by n desc, dist, angle) as rn from c) select image_idx, dist, angle, n from k where rn = 1""")
def _(t):
    """Each value votes for its bin of distance and angle and the eight around it; the fullest bin of an image wins."""
    b = t.obs.select("image_idx", F.floor(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")) / 100).alias("d"), F.floor(F.degrees(F.atan2("v", "u")) + 1e-9).alias("a"))
    step = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    n = b.groupBy("image_idx", "d", "a").agg(F.count("*").alias("m")).withColumn("x", step).withColumn("y", step)
    c = n.groupBy("image_idx", (F.col("d") + F.col("x")).alias("dist"), (F.col("a") + F.col("y")).alias("angle")).agg(F.sum("m").alias("n"))
    best = c.groupBy("image_idx").agg(F.min(F.struct(-F.col("n"), "dist", "angle", "n")).alias("k"))
    return best.select("image_idx", F.col("k.dist").alias("dist"), F.col("k.angle").alias("angle"), F.col("k.n").alias("n"))


@query("e24_texture_clusters")
def _(t):
    """Descriptors in ten clusters by seeded k-means; rows and cluster sizes are checked."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    m = KMeans(k=10, seed=3, maxIter=10).fit(v)
    return m.transform(v).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("v06_grid_search", "with e1 as (select p, avg(abs(n - e * p)) as err from pose, (select 0e0 + range * 0.1e0 as p from range(21)) group by p), b1 as (select p, err from e1 order by err, p limit 1), e2 as (select p, avg(abs(n - e * p)) as err from pose, (select (select p from b1) - (0.1e0 * 0.2e0) * 5 + range * (0.1e0 * 0.2e0) as p from range(11)) group by p), b2 as (select p, err from e2 order by err, p limit 1), e3 as (select p, avg(abs(n - e * p)) as err from pose, (select (select p from b2) - (0.1e0 * 0.2e0 * 0.2e0) * 5 + range * (0.1e0 * 0.2e0 * 0.2e0) as p from range(11)) group by p), b3 as (select p, err from e3 order by err, p limit 1) select round(p, 6) as k, round(err, 5) as err from b3")
def _(t):
    """One-parameter search (V06): a grid, then two finer ones about the best; all places of a grid are one aggregate."""
    k, err = grid_search(t.pose, lambda p: F.abs(F.col("n") - F.col("e") * p), 0.0, 2.0, 0.1)
    return t.pose.limit(1).select(r(F.lit(k)).alias("k"), r(F.lit(err), 5).alias("err"))


@query("a38_hulls", """
with p as (select distinct s_nationkey as grp, n, e from pose join supplier on s_suppkey = image_idx),
x as (select a.*, exists (select 1 from p b, p c where b.grp = a.grp and c.grp = a.grp and (b.n, b.e) <> (a.n, a.e) and (c.n, c.e) <> (a.n, a.e) and (b.n, b.e) < (c.n, c.e)
  and not exists (select 1 from p d where d.grp = a.grp and (c.n - b.n) * (d.e - b.e) - (c.e - b.e) * (d.n - b.n) <> 0) and a.n between least(b.n, c.n) and greatest(b.n, c.n) and a.e between least(b.e, c.e) and greatest(b.e, c.e)) as on_line,
  exists (select 1 from p b, p c, p d where b.grp = a.grp and c.grp = a.grp and d.grp = a.grp and (b.n, b.e) <> (a.n, a.e) and (c.n, c.e) <> (a.n, a.e) and (d.n, d.e) <> (a.n, a.e)
  and (c.n - b.n) * (d.e - b.e) - (c.e - b.e) * (d.n - b.n) > 0 and (c.n - b.n) * (a.e - b.e) - (c.e - b.e) * (a.n - b.n) >= 0 and (d.n - c.n) * (a.e - c.e) - (d.e - c.e) * (a.n - c.n) >= 0 and (b.n - d.n) * (a.e - d.e) - (b.e - d.e) * (a.n - d.n) >= 0) as inside from p a)
select grp, n, e from x where not on_line and not inside""")
def _(t):
    """Corners of the convex hull of each group's camera positions."""
    from ..sources.sinks import hulls

    p = t.pose.join(t.supplier.select(F.col("s_suppkey").alias("image_idx"), F.col("s_nationkey").alias("grp")), "image_idx")
    return hulls(p.select("grp", "n", "e"), "grp", "n", "e").select("grp", "n", "e")


@query("v07_rotation_consistency", """
with a as (select image_idx as i, (image_idx * 37 % 360) * 1e0 as yaw from pose), p as (select x.i, y.i as j, x.yaw as yi, y.yaw as yj, (x.i * 7 + y.i * 3) % 90 * 1e0 as seen, 1 + (x.i + y.i) % 5 as w from a x join a y on y.i between x.i + 1 and x.i + 4),
b as (select i, w, (((yj - yi - seen + 180) % 360) + 360) % 360 - 180 as err from p union all select j, w, (((yj - yi - seen + 180) % 360) + 360) % 360 - 180 from p),
m as (select i, sqrt(sum(w * err * err) / sum(w)) as rms from b group by i) select count(*) as images, round(sqrt(avg(rms * rms)), 5) as objective, round(max(rms), 5) as worst from m""")
def _(t):
    """The rotation objective (V07): each image's weighted RMS of what its pairs' turns lack of those seen, then the RMS over images."""
    from ..functions.angles import wrap_180

    yaw = t.pose.select("image_idx", (F.col("image_idx") * 37 % 360 * 1.0).alias("yaw"))
    p = sequence_pairs(yaw, "image_idx", 4)
    seen, w = (F.col("image_idx") * 7 + F.col("image_idx_2") * 3) % 90 * 1.0, 1 + (F.col("image_idx") + F.col("image_idx_2")) % 5
    p = p.select("image_idx", "image_idx_2", w.alias("w"), wrap_180(F.col("yaw_2") - F.col("yaw") - seen).alias("err"))
    both = p.select(F.explode(F.array("image_idx", "image_idx_2")).alias("i"), "w", "err")
    m = both.groupBy("i").agg(F.sqrt(F.sum(F.col("w") * F.col("err") * F.col("err")) / F.sum("w")).alias("rms"))
    return m.agg(F.count("*").alias("images"), r(F.sqrt(F.avg(F.col("rms") * F.col("rms"))), 5).alias("objective"), r(F.max("rms"), 5).alias("worst"))


@query("o08_group_seed", "with c as (select chain_id, count(distinct image_idx) as n from obs group by chain_id having count(distinct image_idx) > 2) select chain_id, n from c order by n desc, chain_id limit 1")
def _(t):
    """The chain that a group starts from (O08): the longest one that touches three images or more, the first of equals."""
    c = t.obs.groupBy("chain_id").agg(F.countDistinct("image_idx").alias("n")).filter("n > 2")
    return c.orderBy(F.desc("n"), "chain_id").limit(1)

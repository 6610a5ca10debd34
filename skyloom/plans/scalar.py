"""Projections and scalar geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, geo, rotation
from ..functions.camera import Camera, on_ground
from .base import query, r

#: A survey camera for the queries: focal lengths, centre, distortion.
CAMERA = Camera(4600.0, 4600.0, 2000.0, 1500.0, (-0.12, 0.8, -0.016, -0.0095, -1.2))
SMALL = Camera(1000.0, 1000.0, 2000.0, 1500.0)
REF = (45.02, -92.98, 0.0)
MOUNT = (0.0, -90.0, 0.0)

Q_SQL = """
  cos(radians({r})/2)*cos(radians({p})/2)*cos(radians({y})/2) + sin(radians({r})/2)*sin(radians({p})/2)*sin(radians({y})/2) as {o}w,
  sin(radians({r})/2)*cos(radians({p})/2)*cos(radians({y})/2) - cos(radians({r})/2)*sin(radians({p})/2)*sin(radians({y})/2) as {o}x,
  cos(radians({r})/2)*sin(radians({p})/2)*cos(radians({y})/2) + sin(radians({r})/2)*cos(radians({p})/2)*sin(radians({y})/2) as {o}y,
  cos(radians({r})/2)*cos(radians({p})/2)*sin(radians({y})/2) - sin(radians({r})/2)*sin(radians({p})/2)*cos(radians({y})/2) as {o}z"""
QUAT = Q_SQL.format(y="yaw_deg", p="pitch_deg", r="roll_deg", o="q")
PROD = """
  aw*bw-ax*bx-ay*by_-az*bz as w, aw*bx+ax*bw+ay*bz-az*by_ as x, aw*by_-ax*bz+ay*bw+az*bx as y, aw*bz+ax*by_-ay*bx+az*bw as z"""


@query("p01_dms_to_decimal", "select o_orderkey as id, round((o_orderkey % 90 + (o_custkey % 60) / 60e0 + (o_orderkey % 3600) / 60e0 / 3600e0) * (case when o_orderkey % 4 < 2 then -1e0 else 1e0 end), 9) + 0e0 as deg from orders")
def _(t):
    sign = F.element_at(F.array(*map(F.lit, "SWNE")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    x = angles.dms_to_decimal(F.col("o_orderkey") % 90, F.col("o_custkey") % 60, (F.col("o_orderkey") % 3600) / 60.0, sign)
    return t.orders.select(F.col("o_orderkey").alias("id"), r(x, 9).alias("deg"))


@query("p02_decimal_to_dms", """
with a as (select o_orderkey as id, abs(o_totalprice / 3e3 - 60e0) as a from orders),
b as (select id, a, floor(a) as d from a), c as (select id, a, d, floor((a - d) * 60) as m from b)
select id, cast(d as bigint) as d, cast(m as bigint) as m, round(((a - d) * 60 - m) * 60, 5) + 0e0 as s from c""")
def _(t):
    d, m, s = angles.decimal_to_dms(F.col("o_totalprice") / 3e3 - 60)
    return t.orders.select(F.col("o_orderkey").alias("id"), d.cast("long").alias("d"), m.cast("long").alias("m"), r(s, 5).alias("s"))


@query("p03_reference_point", "select round(avg(lat_deg), 9) as lat, round(avg(lon_deg), 9) as lon, 0e0 as alt from img")
def _(t):
    return t.img.agg(r(F.avg("lat_deg"), 9).alias("lat"), r(F.avg("lon_deg"), 9).alias("lon")).withColumn("alt", F.lit(0.0))


NED = """
a as (select image_idx, radians(lat_deg) la, radians(lon_deg) lo, alt_m h, yaw_deg, pitch_deg, roll_deg from img),
b as (select *, 6378137e0 / sqrt(1 - 0.0066943799901413165 * sin(la) * sin(la)) as nn from a),
c as (select *, (nn + h) * cos(la) * cos(lo) as x, (nn + h) * cos(la) * sin(lo) as y, (nn * (1 - 0.0066943799901413165) + h) * sin(la) as z from b),
p as (select radians(45.02e0) as l0, radians(-92.98e0) as o0),
q as (select *, 6378137e0 / sqrt(1 - 0.0066943799901413165 * sin(l0) * sin(l0)) as n0 from p),
d as (select c.*, l0, o0, x - n0 * cos(l0) * cos(o0) as dx, y - n0 * cos(l0) * sin(o0) as dy, z - n0 * (1 - 0.0066943799901413165) * sin(l0) as dz from c, q),
ned as (select image_idx, yaw_deg, pitch_deg, roll_deg, -sin(l0)*cos(o0)*dx - sin(l0)*sin(o0)*dy + cos(l0)*dz as n, -sin(o0)*dx + cos(o0)*dy as e,
  -cos(l0)*cos(o0)*dx - cos(l0)*sin(o0)*dy - sin(l0)*dz as d from d)"""


def ned_of(df):
    ref = [F.lit(x) for x in REF]
    n, e, d = geo.lla_to_ned(F.col("lat_deg"), F.col("lon_deg"), F.col("alt_m"), *ref)
    return df.withColumns({"n": n, "e": e, "d": d})


@query("p04_lla_to_ned", f"with {NED} select image_idx, round(n, 4) + 0e0 as n, round(e, 4) + 0e0 as e, round(d, 4) + 0e0 as d from ned")
def _(t):
    return ned_of(t.img).select("image_idx", *(r(F.col(c), 4).alias(c) for c in "ned"))


@query("p05_ned_to_lla", "select image_idx, round(lat_deg, 7) + 0e0 as lat, round(lon_deg, 7) + 0e0 as lon, round(alt_m, 3) + 0e0 as alt from img")
def _(t):
    """Round trip: positions go to NED and come back by a fixed-point iteration."""
    x, y, z = geo.ned_to_ecef(F.col("n"), F.col("e"), F.col("d"), *map(F.lit, REF))
    df = ned_of(t.img).select("image_idx", x.alias("x"), y.alias("y"), z.alias("z"))
    df = df.withColumn("p", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).withColumn("la", F.atan2("z", F.col("p") * (1 - geo.E2)))
    for _ in range(4):
        df = df.withColumn("la", geo.latitude_step(F.col("z"), F.col("p"), F.col("la")))
    nn = geo.A / F.sqrt(1 - geo.E2 * F.sin("la") * F.sin("la"))
    lon = F.degrees(F.atan2("y", "x"))
    return df.select("image_idx", r(F.degrees("la"), 7).alias("lat"), r(lon, 7).alias("lon"), r(F.col("p") / F.cos("la") - nn, 3).alias("alt"))


@query("p06_flat_xy", """
with a as (select image_idx, lat_deg, lon_deg, (lon_deg + 92.98e0) * 60 * 1852 * cos(radians(45.02e0)) as x, (lat_deg - 45.02e0) * 60 * 1852 as y from img)
select image_idx, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(lon_deg, 8) + 0e0 as lon, round(lat_deg, 8) + 0e0 as lat from a""")
def _(t):
    la, lo = F.lit(REF[0]), F.lit(REF[1])
    x, y = geo.flat_xy(F.col("lat_deg"), F.col("lon_deg"), la, lo)
    lon, lat = geo.flat_lonlat(F.col("x"), F.col("y"), la, lo)
    return t.img.withColumns({"x": x, "y": y}).select("image_idx", r("x", 5).alias("x"), r("y", 5).alias("y"), r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


def quat_of(df, mount=False):
    q = rotation.from_ypr(F.col("yaw_deg"), F.col("pitch_deg"), F.col("roll_deg"))
    df = df.withColumns(dict(zip(("qw", "qx", "qy", "qz"), q)))
    if mount:
        m = rotation.from_ypr(*map(F.lit, MOUNT))
        p = rotation.product(tuple(map(F.col, ("qw", "qx", "qy", "qz"))), m)
        df = df.withColumns(dict(zip(("cw", "cx", "cy", "cz"), p)))
    return df




def cols(*names):
    return tuple(F.col(n) for n in names)


@query("p07_quaternions", f"""
with a as (select image_idx, {Q_SQL.format(y="yaw_deg", p="pitch_deg", r="roll_deg", o="a")}, {Q_SQL.format(y="30e0", p="-90e0", r="0e0", o="b").replace("as by", "as by_")} from img),
b as (select image_idx, {PROD} from a)
select image_idx, round(w, 7) + 0e0 as w, round(x, 7) + 0e0 as x, round(y, 7) + 0e0 as y, round(z, 7) + 0e0 as z,
  round(w / (w*w+x*x+y*y+z*z), 7) + 0e0 as iw, round(-x / (w*w+x*x+y*y+z*z), 7) + 0e0 as ix from b""")
def _(t):
    m = rotation.from_ypr(F.lit(30.0), F.lit(-90.0), F.lit(0.0))
    p = rotation.product(cols("qw", "qx", "qy", "qz"), m)
    i = rotation.inverse(p)
    return quat_of(t.img).select("image_idx", *(r(c, 7).alias(n) for c, n in zip((*p, i[0], i[1]), ("w", "x", "y", "z", "iw", "ix"))))


@query("p08_camera_pose", f"""
with {NED}, a1 as (select image_idx, n, e, d, {Q_SQL.format(y="yaw_deg", p="pitch_deg", r="roll_deg", o="a")}, {Q_SQL.format(y="0e0", p="-90e0", r="0e0", o="b").replace("as by", "as by_")} from ned),
b1 as (select image_idx, n, e, d, {PROD} from a1)
select image_idx, round(n, 4) + 0e0 as n, round(e, 4) + 0e0 as e, round(d, 4) + 0e0 as d, round(w, 6) + 0e0 as w, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, round(z, 6) + 0e0 as z,
  round(degrees(asin(greatest(-1e0, least(1e0, 2*(w*y-x*z))))), 3) + 0e0 as pitch from b1""")
def _(t):
    df = quat_of(ned_of(t.img), mount=True)
    q = cols("cw", "cx", "cy", "cz")
    pitch = rotation.to_ypr(q)[1]
    return df.select("image_idx", *(r(F.col(c), 4).alias(c) for c in "ned"), *(r(c, 6).alias(n) for c, n in zip(q, "wxyz")), r(pitch, 3).alias("pitch"))


@query("p09_yaw_bias", f"""
with a as (select image_idx, {Q_SQL.format(y="(yaw_deg + image_idx % 7)", p="pitch_deg", r="roll_deg", o="q")} from img)
select image_idx, round(qw, 7) + 0e0 as w, round(qx, 7) + 0e0 as x, round(qy, 7) + 0e0 as y, round(qz, 7) + 0e0 as z from a""")
def _(t):
    q = rotation.from_ypr(F.col("yaw_deg") + F.col("image_idx") % 7, F.col("pitch_deg"), F.col("roll_deg"))
    return t.img.select("image_idx", *(r(c, 7).alias(n) for c, n in zip(q, "wxyz")))


MATRIX = """
  1-2*(qy*qy+qz*qz) as m00, 2*(qx*qy-qw*qz) as m01, 2*(qx*qz+qw*qy) as m02, 2*(qx*qy+qw*qz) as m10, 1-2*(qx*qx+qz*qz) as m11, 2*(qy*qz-qw*qx) as m12,
  2*(qx*qz-qw*qy) as m20, 2*(qy*qz+qw*qx) as m21, 1-2*(qx*qx+qy*qy) as m22"""


@query("p10_projection", f"""
with {NED}, a1 as (select image_idx, n, e, d, {QUAT} from ned), b1 as (select image_idx, n, e, d, {MATRIX} from a1)
select image_idx, round(m00, 6) + 0e0 as r00, round(m11, 6) + 0e0 as r11, round(m22, 6) + 0e0 as r22, round(-(m00*n+m10*e+m20*d), 3) + 0e0 as t0,
  round(-(m01*n+m11*e+m21*d), 3) + 0e0 as t1, round(-(m02*n+m12*e+m22*d), 3) + 0e0 as t2 from b1""")
def _(t):
    df = quat_of(ned_of(t.img))
    m = rotation.matrix(cols("qw", "qx", "qy", "qz"))
    shift = [-(m[0][k] * F.col("n") + m[1][k] * F.col("e") + m[2][k] * F.col("d")) for k in range(3)]
    return df.select("image_idx", *(r(m[k][k], 6).alias(f"r{k}{k}") for k in range(3)), *(r(c, 3).alias(f"t{k}") for k, c in enumerate(shift)))


RAY = f"""
a as (select image_idx, n, e, d, {QUAT} from (select image_idx, n, e, d, yaw_deg, pitch_deg, roll_deg from pose join img using (image_idx)) z),
b as (select image_idx, n, e, d, {MATRIX} from a),
g as (select unnest([0e0, 2000e0, 4000e0]) as u), h as (select unnest([0e0, 3000e0]) as v),
k as (select b.*, u, v, (u-2000e0)/1000e0 as x, (v-1500e0)/1000e0 as y from b, g, h),
l as (select *, m00+m01*x+m02*y as rn, m10+m11*x+m12*y as re, m20+m21*x+m22*y as rd from k),
ray as (select *, sqrt(rn*rn+re*re+rd*rd) as s from l)"""


def rays(t):
    df = quat_of(t.pose.join(t.img.select("image_idx", "yaw_deg", "pitch_deg", "roll_deg"), "image_idx"))
    df = df.withColumn("u", F.explode(F.array(*map(F.lit, (0.0, 2000.0, 4000.0))))).withColumn("v", F.explode(F.array(F.lit(0.0), F.lit(3000.0))))
    ray = SMALL.ray(F.col("u"), F.col("v"), cols("qw", "qx", "qy", "qz"))
    return df.withColumns(dict(zip(("rn", "re", "rd"), ray)))


@query("p11_pixel_ray", f"with {RAY} select image_idx, u, v, round(rn/s, 6) + 0e0 as rn, round(re/s, 6) + 0e0 as re, round(rd/s, 6) + 0e0 as rd from ray")
def _(t):
    return rays(t).select("image_idx", "u", "v", *(r(c, 6).alias(c) for c in ("rn", "re", "rd")))


@query("p12_ground_intersection", f"""
with {RAY} select image_idx, u, v, round(case when rd/s > 1e-3 then n + (0e0-d)/(rd/s)*(rn/s) else n end, 3) + 0e0 as gn,
  round(case when rd/s > 1e-3 then e + (0e0-d)/(rd/s)*(re/s) else e end, 3) + 0e0 as ge from ray""")
def _(t):
    df = rays(t).withColumn("rd", F.when(F.col("rd") > 1e-3, F.col("rd")).otherwise(-1.0))
    g = on_ground(cols("rn", "re", "rd"), cols("n", "e", "d"), F.lit(0.0))
    return df.select("image_idx", "u", "v", r(g[0], 3).alias("gn"), r(g[1], 3).alias("ge"))


DIST = "(-0.12e0)", "0.8e0", "(-0.016e0)", "(-0.0095e0)", "(-1.2e0)"
RADIAL = f"(1 + {DIST[0]}*r2 + {DIST[1]}*r2*r2 + {DIST[4]}*r2*r2*r2)"
TX, TY = f"(2*{DIST[2]}*x*y + {DIST[3]}*(r2+2*x*x))", f"({DIST[2]}*(r2+2*y*y) + 2*{DIST[3]}*x*y)"
STEP = "".join(
    f", s{k}r as (select *, x*x+y*y as r2 from s{k}), s{k + 1} as (select id, x0, y0, (x0 - {TX}) / {RADIAL} as x, (y0 - {TY}) / {RADIAL} as y from s{k}r)" for k in range(5)
)


@query("p13_distort", f"""
with a as (select id, (u-2000e0)/4600.0e0 as x, (v-1500e0)/4600.0e0 as y from uv), b as (select *, x*x+y*y as r2 from a)
select id, round((x*{RADIAL}+{TX})*4600.0e0+2000e0, 5) + 0e0 as u, round((y*{RADIAL}+{TY})*4600.0e0+1500e0, 5) + 0e0 as v from b""")
def _(t):
    u, v = CAMERA.distort(F.col("u"), F.col("v"))
    return t.uv.select("id", r(u, 5).alias("u"), r(v, 5).alias("v"))


@query("p14_undistort", f"""
with a as (select id, (u-2000e0)/4600.0e0 as x0, (v-1500e0)/4600.0e0 as y0 from uv), s0 as (select id, x0, y0, x0 as x, y0 as y from a){STEP}
select id, round(x*4600.0e0+2000e0, 5) + 0e0 as u, round(y*4600.0e0+1500e0, 5) + 0e0 as v from s5""")
def _(t):
    x, y = CAMERA.normal(F.col("u"), F.col("v"))
    df = t.uv.select("id", x.alias("x0"), y.alias("y0"), x.alias("x"), y.alias("y"))
    for _ in range(5):
        x, y = CAMERA.undistort_step(*cols("x0", "y0", "x", "y"))
        df = df.select("id", "x0", "y0", x.alias("x"), y.alias("y"))
    u, v = CAMERA.pixel(F.col("x"), F.col("y"))
    return df.select("id", r(u, 5).alias("u"), r(v, 5).alias("v"))


@query("p15_project_ned", f"""
with o as (select distinct image_idx, chain_id from obs), a as (select image_idx, chain_id, feat.n - pose.n as n, feat.e - pose.e as e, feat.d - pose.d as d, yaw_deg, -80e0 as pitch_deg, roll_deg / 10 as roll_deg
  from o join pose using (image_idx) join img using (image_idx) join feat using (chain_id)),
b as (select image_idx, chain_id, n, e, d, {QUAT} from a), c as (select *, {MATRIX} from b),
f as (select image_idx, chain_id, m00*n+m10*e+m20*d as ah, m01*n+m11*e+m21*d as ri, m02*n+m12*e+m22*d as dn from c)
select image_idx, chain_id, round(case when ah > 0.2e0 then ri/ah*1000e0+2000e0 end, 3) + 0e0 as u, round(case when ah > 0.2e0 then dn/ah*1000e0+1500e0 end, 3) + 0e0 as v from f""")
def _(t):
    df = t.obs.select("image_idx", "chain_id").distinct().join(t.pose, "image_idx").join(t.img.select("image_idx", "yaw_deg", (F.col("roll_deg") / 10).alias("roll_deg")), "image_idx")
    df = df.join(t.feat.toDF("chain_id", "fn", "fe", "fd"), "chain_id").withColumn("pitch_deg", F.lit(-80.0))
    u, v = SMALL.project(cols("qw", "qx", "qy", "qz"), cols("n", "e", "d"), cols("fn", "fe", "fd"))
    return quat_of(df).select("image_idx", "chain_id", r(u, 3).alias("u"), r(v, 3).alias("v"))


@query("p16_decompose_affine", """
with a as (select id, cos(u/500)*(1+v/3000) as a, -sin(u/500)*(1+v/3000) as b, sin(u/500) as c, cos(u/500) as d, u as tx, v as ty from uv)
select id, round(((degrees(atan2(-b, a)) + 180) % 360 + 360) % 360 - 180, 5) + 0e0 as rot, tx, ty, round(sqrt(a*a+b*b), 6) as sx, round(sqrt(c*c+d*d), 6) as sy from a""")
def _(t):
    s = 1 + F.col("v") / 3000
    df = t.uv.select("id", (F.cos(F.col("u") / 500) * s).alias("a"), (-F.sin(F.col("u") / 500) * s).alias("b"), F.sin(F.col("u") / 500).alias("c"), F.cos(F.col("u") / 500).alias("d"), "u", "v")
    rot = angles.wrap_180(F.degrees(F.atan2(-F.col("b"), F.col("a"))))
    return df.select("id", r(rot, 5).alias("rot"), F.col("u").alias("tx"), F.col("v").alias("ty"), r(F.hypot("a", "b")).alias("sx"), r(F.hypot("c", "d")).alias("sy"))


@query("p17_uv_grid", """
with w as (select s_suppkey as image_idx, 3000 + s_nationkey * 10 as w, 2000 + s_nationkey * 10 as h from supplier), g as (select unnest(range(9)) as i), k as (select unnest(range(9)) as j)
select image_idx, i, j, w * i / 8e0 as u, h * j / 8e0 as v from w, g, k""")
def _(t):
    steps = F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))
    df = t.supplier.select(F.col("s_suppkey").alias("image_idx"), (3000 + F.col("s_nationkey") * 10).alias("w"), (2000 + F.col("s_nationkey") * 10).alias("h"))
    df = df.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return df.select("image_idx", "i", "j", (F.col("w") * F.col("i") / 8.0).alias("u"), (F.col("h") * F.col("j") / 8.0).alias("v"))


@query("p18_course_error", """
with a as (select a.image_idx as i, b.image_idx as j, (degrees(atan2(b.e-a.e, b.n-a.n)) % 360 + 360) % 360 as crs, (a.image_idx * 37 % 360) as yaw from pose a join pose b on b.image_idx = a.image_idx + 1)
select i, j, round(crs, 5) + 0e0 as crs, round(((crs - yaw + 180) % 360 + 360) % 360 - 180, 5) + 0e0 as err from a""")
def _(t):
    b = t.pose.select(F.col("image_idx").alias("j"), F.col("n").alias("bn"), F.col("e").alias("be"))
    df = t.pose.join(b, F.col("j") == F.col("image_idx") + 1)
    c = angles.course(F.col("bn") - F.col("n"), F.col("be") - F.col("e"))
    return df.select(F.col("image_idx").alias("i"), "j", r(c, 5).alias("crs"), r(angles.wrap_180(c - F.col("image_idx") * 37 % 360), 5).alias("err"))


@query("p20_subtended_angle", """
select a.image_idx as i, b.image_idx as j, round(degrees(atan2(sqrt((a.n-b.n)*(a.n-b.n)+(a.e-b.e)*(a.e-b.e)), abs(a.d))), 6) + 0e0 as angle from pose a join pose b on b.image_idx between a.image_idx + 1 and a.image_idx + 2""")
def _(t):
    b = t.pose.select(F.col("image_idx").alias("j"), F.col("n").alias("bn"), F.col("e").alias("be"))
    a = t.pose.withColumn("j", F.explode(F.sequence(F.col("image_idx") + 1, F.col("image_idx") + 2)))
    base = F.hypot(F.col("n") - F.col("bn"), F.col("e") - F.col("be"))
    return a.join(b, "j").select(F.col("image_idx").alias("i"), "j", r(F.degrees(F.atan2(base, F.abs("d")))).alias("angle"))


@query("p21_homography", """
with a as (select id, u, v, 1e-4*u - 2e-4*v + 0.1e0 as w from uv)
select id, round(case when abs(w) < 1e-6 then null else (1.01e0*u + 0.02e0*v + 5) / w end, 4) + 0e0 as x, round(case when abs(w) < 1e-6 then null else (-0.02e0*u + 0.99e0*v - 7) / w end, 4) + 0e0 as y from a""")
def _(t):
    w = 1e-4 * F.col("u") - 2e-4 * F.col("v") + 0.1
    safe = F.abs(w) >= 1e-6
    x, y = 1.01 * F.col("u") + 0.02 * F.col("v") + 5, -0.02 * F.col("u") + 0.99 * F.col("v") - 7
    return t.uv.select("id", r(F.when(safe, x / w), 4).alias("x"), r(F.when(safe, y / w), 4).alias("y"))


@query("p22_slope", """
select a.chain_id as i, b.chain_id as j, round((b.d-a.d) / nullif(sqrt((b.n-a.n)*(b.n-a.n)+(b.e-a.e)*(b.e-a.e)), 0), 6) + 0e0 as slope from feat a join feat b on b.chain_id = a.chain_id + 1""")
def _(t):
    b = t.feat.select((F.col("chain_id") - 1).alias("k"), *(F.col(c).alias(f"b{c}") for c in "ned"))
    run = F.hypot(F.col("bn") - F.col("n"), F.col("be") - F.col("e"))
    return t.feat.join(b, F.col("k") == F.col("chain_id")).select(
        F.col("chain_id").alias("i"), (F.col("chain_id") + 1).alias("j"), r(F.try_divide(F.col("bd") - F.col("d"), F.nullif(run, F.lit(0.0)))).alias("slope"))


@query("p23_horizon_attitude", """
with a as (select id, degrees(atan2(v-1500e0, 4000e0)) as roll, u, v from uv)
select id, round(roll, 6) + 0e0 as roll, round(degrees(atan2(((v+1500e0)/2 - 1500e0) * cos(radians(roll)), 1000e0)), 6) + 0e0 as pitch from a""")
def _(t):
    roll = F.degrees(F.atan2(F.col("v") - 1500, F.lit(4000.0)))
    mid = (F.col("v") + 1500) / 2 - SMALL.cv
    return t.uv.select("id", r(roll).alias("roll"), r(F.degrees(F.atan2(mid * F.cos(F.radians(roll)), F.lit(SMALL.fy)))).alias("pitch"))


@query("p24_closest_point", """
with a as (select id, u, v, ((u-100e0)*400e0 + (v-50e0)*300e0) / 250000e0 as s from uv)
select id, round(100e0 + s*400e0, 5) + 0e0 as x, round(50e0 + s*300e0, 5) + 0e0 as y, round(sqrt((u-100e0-s*400e0)*(u-100e0-s*400e0) + (v-50e0-s*300e0)*(v-50e0-s*300e0)), 4) + 0e0 as dist from a""")
def _(t):
    s = ((F.col("u") - 100) * 400 + (F.col("v") - 50) * 300) / 250000
    x, y = 100 + s * 400, 50 + s * 300
    return t.uv.select("id", r(x, 5).alias("x"), r(y, 5).alias("y"), r(F.hypot(F.col("u") - x, F.col("v") - y), 4).alias("dist"))


@query("p25_pixel_rates", """
with a as (select k, event_id, t, x, lag(x) over w as px, lag(t) over w as pt from series window w as (partition by k order by t, event_id))
select k, event_id, round(case when t > pt then (atan((x-50)/1000e0) - atan((px-50)/1000e0)) / (t - pt) * 1e6 else 0e0 end, 5) + 0e0 as rate from a""")
def _(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("k").orderBy("t", "event_id")
    df = t.series.withColumns({"px": F.lag("x").over(w), "pt": F.lag("t").over(w)})
    rate = (F.atan((F.col("x") - 50) / 1000) - F.atan((F.col("px") - 50) / 1000)) / (F.col("t") - F.col("pt")) * 1e6
    return df.select("k", "event_id", r(F.when(F.col("t") > F.col("pt"), rate).otherwise(0.0), 5).alias("rate"))


@query("p26_vignette", """
with a as (select id, ((u-2000e0)*(u-2000e0)+(v-1500e0)*(v-1500e0)) / 6250000e0 as r2 from uv) select id, round(-0.4e0*r2*r2 - 0.2e0*r2 + 1, 6) + 0e0 as gain from a""")
def _(t):
    r2 = ((F.col("u") - 2000) ** 2 + (F.col("v") - 1500) ** 2) / 6250000
    return t.uv.select("id", r(-0.4 * r2 * r2 - 0.2 * r2 + 1).alias("gain"))


@query("p27_colour_indices", """
with a as (select id, u % 256 as red, v % 256 as green, (u+v) % 256 as blue from uv), b as (select *, greatest(red, green, blue) as hi, least(red, green, blue) as lo from a),
c as (select *, case when hi = lo then 0e0 when hi = red then 60*((green-blue)/(hi-lo)) when hi = green then 60*(2+(blue-red)/(hi-lo)) else 60*(4+(red-green)/(hi-lo)) end as hue from b)
select id, round(red / nullif(red+green+blue, 0), 6) + 0e0 as redness, round(least(4e0, red / greatest(green, 1e0)), 6) + 0e0 as ratio, round(abs(((hue - 10 + 180) % 360 + 360) % 360 - 180), 5) + 0e0 as hue_dist from c""")
def _(t):
    df = t.uv.select("id", (F.col("u") % 256).alias("red"), (F.col("v") % 256).alias("green"), ((F.col("u") + F.col("v")) % 256).alias("blue"))
    df = df.withColumns({"hi": F.greatest("red", "green", "blue"), "lo": F.least("red", "green", "blue")})
    c, span = F.col, F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    hue = F.when(c("hi") == c("lo"), 0.0).when(c("hi") == c("red"), 60 * ((c("green") - c("blue")) / span)).when(c("hi") == c("green"), 60 * (2 + (c("blue") - c("red")) / span)).otherwise(60 * (4 + (c("red") - c("green")) / span))
    total = F.nullif(c("red") + c("green") + c("blue"), F.lit(0.0))
    return df.select("id", r(c("red") / total).alias("redness"), r(F.least(F.lit(4.0), c("red") / F.greatest("green", F.lit(1.0)))).alias("ratio"), r(F.abs(angles.wrap_180(hue - 10)), 5).alias("hue_dist"))


@query("p28_false_colour", """
with l as (select i, i / 255e0 as x from (select unnest(range(256)) as i) z)
select i, cast(floor(case when x < 0.25e0 then 0 when x < 0.5e0 then (x-0.25e0)/0.25e0*255 else 255 end) as bigint) as red,
 cast(floor(case when x < 0.25e0 then x/0.25e0*255 when x < 0.75e0 then 255 else (1-x)/0.25e0*255 end) as bigint) as green from l""")
def _(t):
    x = F.col("id") / 255.0
    red = F.when(x < 0.25, 0).when(x < 0.5, (x - 0.25) / 0.25 * 255).otherwise(255)
    green = F.when(x < 0.25, x / 0.25 * 255).when(x < 0.75, 255).otherwise((1 - x) / 0.25 * 255)
    return t.spark.range(256).select(F.col("id").alias("i"), F.floor(red).alias("red"), F.floor(green).alias("green"))


@query("p29_min_max", "with a as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer) select c_custkey as id, round((c_acctbal-lo)/(hi-lo), 8) as x from customer, a")
def _(t):
    """The extremes are one row, so the join is a broadcast of one row."""
    ends = t.customer.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return t.customer.join(F.broadcast(ends)).select(F.col("c_custkey").alias("id"), r((F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), 8).alias("x"))


@query("p30_sun_direction", """
with a as (select event_id, (epoch_us(ts) / 1e6 - 946728000e0) / 86400e0 as n from events),
b as (select *, radians((280.46e0 + 0.9856474e0*n) % 360) as l, radians((357.528e0 + 0.9856003e0*n) % 360) as g from a),
c as (select *, l + radians(1.915e0)*sin(g) + radians(0.020e0)*sin(2*g) as lam, radians(23.439e0 - 4e-7*n) as eps from b),
d as (select *, asin(sin(eps)*sin(lam)) as dec, atan2(cos(eps)*sin(lam), cos(lam)) as ra, radians((280.46061837e0 + 360.98564736629e0*n - 93e0) % 360) as lst from c),
e as (select *, lst - ra as ha, radians(45e0) as la from d)
select event_id, round(cos(la)*sin(dec) - sin(la)*cos(dec)*cos(ha), 5) + 0e0 as north, round(-cos(dec)*sin(ha), 5) + 0e0 as east, round(-(sin(la)*sin(dec) + cos(la)*cos(dec)*cos(ha)), 5) + 0e0 as down from e""")
def _(t):
    n = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 946728000.0) / 86400.0
    df = t.events.select("event_id", n.alias("n"))
    l, g = F.radians((280.46 + 0.9856474 * F.col("n")) % 360), F.radians((357.528 + 0.9856003 * F.col("n")) % 360)
    lam = l + F.radians(F.lit(1.915)) * F.sin(g) + F.radians(F.lit(0.020)) * F.sin(2 * g)
    df = df.withColumns({"lam": lam, "eps": F.radians(23.439 - 4e-7 * F.col("n"))})
    dec, ra = F.asin(F.sin("eps") * F.sin("lam")), F.atan2(F.cos("eps") * F.sin("lam"), F.cos("lam"))
    df = df.withColumns({"dec": dec, "ha": F.radians((280.46061837 + 360.98564736629 * F.col("n") - 93.0) % 360) - ra})
    la, c, s = F.radians(F.lit(45.0)), F.cos, F.sin
    return df.select("event_id", r(c(la) * s("dec") - s(la) * c("dec") * c("ha"), 5).alias("north"), r(-c("dec") * s("ha"), 5).alias("east"), r(-(s(la) * s("dec") + c(la) * c("dec") * c("ha")), 5).alias("down"))


@query("p31_units", """
select c_custkey as id, round(c_acctbal * 0.3048e0, 6) + 0e0 as m, round(c_acctbal * 0.514444e0, 6) + 0e0 as mps, round((c_acctbal / 100 - 32) * 5 / 9, 6) + 0e0 as celsius, round(c_acctbal * 0.0002953e0, 6) + 0e0 as inhg,
 cast(round_even(abs(c_custkey) * 7 % 360 / 10e0, 0) * 10 as bigint) as wind from customer""")
def _(t):
    b = F.col("c_acctbal")
    wind = (F.bround(F.abs("c_custkey") * 7 % 360 / 10.0) * 10).cast("long")
    return t.customer.select(F.col("c_custkey").alias("id"), r(b * 0.3048).alias("m"), r(b * 0.514444).alias("mps"), r((b / 100 - 32) * 5 / 9).alias("celsius"), r(b * 0.0002953).alias("inhg"), wind.alias("wind"))


@query("p32_affine", """
select chain_id, round(1.01e0*n - 0.1e0*e + 0.02e0*d + 3, 5) + 0e0 as n, round(0.1e0*n + 1.02e0*e - 0.03e0*d - 4, 5) + 0e0 as e, round(0.01e0*n + 0.02e0*e + 0.99e0*d + 5, 5) + 0e0 as d from feat""")
def _(t):
    a = ((1.01, -0.1, 0.02, 3), (0.1, 1.02, -0.03, -4), (0.01, 0.02, 0.99, 5))
    return t.feat.select("chain_id", *(r(x * F.col("n") + y * F.col("e") + z * F.col("d") + s, 5).alias(c) for c, (x, y, z, s) in zip("ned", a)))

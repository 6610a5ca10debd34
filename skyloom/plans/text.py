"""Strings, times, arrays, JSON (X01-X20), crowd labels (J06, X14, A27) and superseded variants (V*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import ranked
from .base import query, r


@query("x01_uv_key", "select cast(round(u * 100) as bigint) as ku, cast(round(v * 100) as bigint) as kv, count(*) as n from uv group by all")
def _(t):
    return t.uv.groupBy(F.round(F.col("u") * 100).cast("long").alias("ku"), F.round(F.col("v") * 100).cast("long").alias("kv")).agg(F.count("*").alias("n"))


@query("x02_composite_key", "select chain_id, image_idx, chain_id || '-' || image_idx as key from obs where v = 50")
def _(t):
    return t.obs.filter("v = 50").select("chain_id", "image_idx", F.concat_ws("-", "chain_id", "image_idx").alias("key"))


@query("x03_strings", "select s_suppkey as id, lower(replace(s_name, '#', '_')) as name, contains(s_name, '1') as has_one, starts_with(s_name, 'Supp') as is_supp, trim('  ' || s_name || ' ') as tidy from supplier")
def _(t):
    n = F.col("s_name")
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.lower(F.replace(n, F.lit("#"), F.lit("_"))).alias("name"), n.contains("1").alias("has_one"), n.startswith("Supp").alias("is_supp"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tidy"))


@query("x04_regex", "select page_id, regexp_extract(url, '/(\\d+)', 1) as num, regexp_extract(url, '^(https?)://', 1) as scheme, len(string_split(url, '/')) as parts from pages")
def _(t):
    u = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(u, r"/(\d+)", 1).alias("num"), F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.size(F.split(u, "/")).cast("long").alias("parts"))


@query("x05_add_to_number", "select s_suppkey as id, 'IMG_' || lpad(cast(s_suppkey + 17 as varchar), 6, '0') || '.JPG' as name from supplier")
def _(t):
    name = F.format_string("IMG_%05d.jpg", "s_suppkey")
    n = F.regexp_extract(name, r"(\d+)", 1).cast("long") + 17
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("IMG_"), F.lpad(n.cast("string"), 6, "0"), F.lit(".JPG")).alias("name"))


@query("x06_tile_name", "select image_idx, (case when lat_deg >= 0 then 'N' else 'S' end) || lpad(cast(abs(floor(lat_deg))::bigint as varchar), 2, '0') || (case when lon_deg >= 0 then 'E' else 'W' end) || lpad(cast(abs(floor(lon_deg))::bigint as varchar), 3, '0') as tile from img")
def _(t):
    from ..sources.terrain import tile_name

    return t.img.select("image_idx", tile_name(F.col("lat_deg"), F.col("lon_deg")).alias("tile"))


@query("x07_sub_image", "select s_suppkey as id, s_name as root, s_suppkey % 4 as i, s_nationkey % 4 as j from supplier")
def _(t):
    """Row and column of a chopped image from its name root_ij.ext."""
    name = F.concat("s_name", F.lit("_"), (F.col("s_suppkey") % 4).cast("string"), (F.col("s_nationkey") % 4).cast("string"), F.lit(".png"))
    part = lambda k: F.regexp_extract(name, r"^(.*)_(\d)(\d)\.\w+$", k)
    return t.supplier.select(F.col("s_suppkey").alias("id"), part(1).alias("root"), part(2).cast("long").alias("i"), part(3).cast("int").alias("j"))


@query("x08_exif_time", "select o_orderkey as id, epoch(o_orderdate)::bigint as unix from orders")
def _(t):
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy:MM:dd HH:mm:ss")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.unix_timestamp(text, "yyyy:MM:dd HH:mm:ss").alias("unix"))


@query("x09_twelve_hour", "select event_id, epoch(date_trunc('second', ts))::bigint as unix from events")
def _(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd hh:mm:ss a")
    return t.events.select("event_id", F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd hh:mm:ss a")).alias("unix"))


@query("x10_subtitle_time", "select o_orderkey as id, round((o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + o_orderkey % 60 + (o_custkey % 1000) / 1e3, 3) as sec from orders")
def _(t):
    from ..sources.flight import srt_seconds

    text = F.format_string("%02d:%02d:%02d,%03d", F.col("o_orderkey") % 24, F.col("o_custkey") % 60, F.col("o_orderkey") % 60, F.col("o_custkey") % 1000)
    return t.orders.select(F.col("o_orderkey").alias("id"), r(srt_seconds(text), 3).alias("sec"))


@query("x11_frame_rate", "select p_partkey as id, round((p_size * 1000e0) / 1001, 6) as fps from part")
def _(t):
    parts = F.split(F.concat_ws("/", F.col("p_size") * 1000, F.lit(1001)), "/")
    return t.part.select(F.col("p_partkey").alias("id"), r(parts[0].cast("double") / parts[1].cast("double")).alias("fps"))


@query("x12_wrap_angles", "with a as (select c_custkey as id, c_acctbal as d from customer) select id, round(((d % 360) + 360) % 360, 4) + 0e0 as w360, round((((d + 180) % 360) + 360) % 360 - 180, 4) + 0e0 as w180, round((((d + 90) % 180) + 180) % 180 - 90, 4) + 0e0 as w90 from a")
def _(t):
    from ..functions import angles

    d = F.col("c_acctbal")
    return t.customer.select(F.col("c_custkey").alias("id"), r(angles.wrap_360(d), 4).alias("w360"), r(angles.wrap_180(d), 4).alias("w180"), r(angles.wrap_90(d), 4).alias("w90"))


@query("x13_rounding", "select p_partkey as id, round_even(p_size / 2e0, 0)::bigint as half_even, trunc(-p_retailprice)::bigint as cut from part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.bround(F.col("p_size") / 2.0).cast("long").alias("half_even"), (-F.col("p_retailprice")).cast("long").alias("cut"))


@query("x14_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, coalesce(cast(json_extract(props, '$.missing') as bigint), -1) as m from events")
def _(t):
    j = F.from_json("props", "k long, missing long")
    return t.events.select("event_id", j.k.alias("k"), F.coalesce(j.missing, F.lit(-1)).alias("m"))


@query("x15_linspace", "with e as (select s_suppkey as id, unnest(range(5)) as i from supplier) select id, i, i * 1e0 * id / 4 as x from e")
def _(t):
    """Five even steps from zero, exploded with their positions."""
    xs = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i * 1.0 * F.col("s_suppkey") / 4)
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.posexplode(xs).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("x16_vectors", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: power(x::double, 2)))), 5) as norm, round(list_dot_product(embedding::double[], list_reverse(embedding::double[])), 5) + 0e0 as dot from embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.select("vec_id", r(F.sqrt(add(F.transform(v, lambda x: x * x))), 5).alias("norm"), r(add(F.zip_with(v, F.reverse(v), lambda x, y: x * y)), 5).alias("dot"))


@query("x17_clamped_interp", "select id, round(case when u <= 500 then 0e0 when u >= 3500 then 1e0 else (u - 500) / 3000 end, 6) as y from uv")
def _(t):
    return t.uv.select("id", r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("u") - 500) / 3000))).alias("y"))


@query("x18_array_clip", "select vec_id, list_max(embedding)::double as hi, list_min(embedding)::double as lo, len(list_filter(embedding, lambda x: abs(x) > 1)) as big from embeddings")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.array_max(e).cast("double").alias("hi"), F.array_min(e).cast("double").alias("lo"), F.size(F.filter(e, lambda x: F.abs(x) > 1)).cast("long").alias("big"))


@query("x19_event_messages", "select conv_id, turn, string_split(text, ' ')[1] as first, regexp_extract(text, '([A-Za-z]+)', 1) as word, len(string_split(text, ' ')) as n from conversations")
def _(t):
    words = F.split("text", " ")
    return t.conversations.select("conv_id", "turn", words[0].alias("first"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("word"), F.size(words).cast("long").alias("n"))


@query("x20_seeded_sample")
def _(t):
    """A seeded sample of features; the same rows at each run."""
    return t.uv.sample(0.02, seed=7).select("id", "u", "v")


@query("label_clusters", """
with l as (select event_id, user_id % 20 as subject, cast(json_extract(props, '$.k') as double) as px, value from events where event_type <> 'click'),
g as (select l.subject, s_nationkey as set_id, px * 3 as n, value * 2 as e from l join supplier on s_suppkey = l.subject)
select set_id, round_even(n / 20, 0)::bigint as cn, round_even(e / 20, 0)::bigint as ce, count(*) as cnt, round(avg(n), 5) + 0e0 as n, round(avg(e), 5) as e from g group by 1, 2, 3""")
def _(t):
    """Crowd labels: JSON cells, subjects and sets joined, positions rounded into clusters."""
    l = t.events.filter("event_type <> 'click'").select((F.col("user_id") % 20).alias("subject"), F.from_json("props", "k double").k.alias("px"), "value")
    g = l.join(t.supplier.select(F.col("s_suppkey").alias("subject"), F.col("s_nationkey").alias("set_id")), "subject").select("set_id", (F.col("px") * 3).alias("n"), (F.col("value") * 2).alias("e"))
    key = {"cn": F.bround(F.col("n") / 20).cast("long"), "ce": F.bround(F.col("e") / 20).cast("long")}
    return g.withColumns(key).groupBy("set_id", "cn", "ce").agg(F.count("*").alias("cnt"), r(F.avg("n"), 5).alias("n"), r(F.avg("e"), 5).alias("e"))


@query("v01_vertex_ids", "with k as (select chain_id, round(n / 10) as kn, round(e / 10) as ke from feat) select chain_id, dense_rank() over (order by kn, ke) - 1 as vertex from k")
def _(t):
    """Vertices with equal rounded coordinates share a dense index; the index is made over distinct vertices."""
    k = t.feat.select("chain_id", F.round(F.col("n") / 10).alias("kn"), F.round(F.col("e") / 10).alias("ke"))
    ids = ranked(k.select("kn", "ke").distinct(), ["kn", "ke"], "v").withColumn("vertex", F.col("v") - 1)
    return k.join(ids, ["kn", "ke"]).select("chain_id", "vertex")


@query("v02_pairwise_means", "with o as (select distinct chain_id, image_idx from obs), p as (select a.chain_id, (pa.n + pb.n) / 2 as n from o a join o b on a.chain_id = b.chain_id and a.image_idx < b.image_idx join pose pa on pa.image_idx = a.image_idx join pose pb on pb.image_idx = b.image_idx where power(pa.n - pb.n, 2) + power(pa.e - pb.e, 2) >= 1600) select chain_id, count(*) as pairs, round(avg(n), 5) as n from p group by chain_id")
def _(t):
    """Pairs of a chain's images with a baseline of 40 m or more, averaged."""
    o = t.obs.select("chain_id", "image_idx").distinct().join(t.pose, "image_idx").select("chain_id", "image_idx", "n", "e")
    p = o.join(o.toDF("chain_id", "j", "n2", "e2"), "chain_id").filter("image_idx < j and (n - n2) * (n - n2) + (e - e2) * (e - e2) >= 1600")
    return p.groupBy("chain_id").agg(F.count("*").alias("pairs"), r(F.avg((F.col("n") + F.col("n2")) / 2), 5).alias("n"))


@query("v04_damped_relaxation", "with s0 as (select image_idx, n from pose)" + "".join(f", s{k + 1} as (select a.image_idx, a.n + 0.3e0 * (coalesce(avg(b.n), a.n) - a.n) as n from s{k} a left join s{k} b on b.image_idx between a.image_idx + 1 and a.image_idx + 2 group by a.image_idx, a.n)" for k in range(4)) + " select image_idx, round(n, 6) as n from s4")
def _(t):
    """Four rounds of moving each image part of the way to the mean of its two successors, all at once."""
    from ..operators.joins import sequence_pairs

    now = t.pose.select("image_idx", "n")
    for _ in range(4):
        m = sequence_pairs(now, "image_idx", 2).groupBy("image_idx").agg(F.avg("n_2").alias("m"))
        now = now.join(m, "image_idx", "left").select("image_idx", (F.col("n") + 0.3 * (F.coalesce("m", "n") - F.col("n"))).alias("n"))
    return now.select("image_idx", r("n").alias("n"))


@query("v08_collapse", "with k as (select chain_id, image_idx, row_number() over (partition by image_idx, v order by u, chain_id) as rn from obs), o as (select chain_id, image_idx from k where rn = 1) select chain_id, count(distinct image_idx) as images from o group by chain_id having count(distinct image_idx) >= 3")
def _(t):
    w = Window.partitionBy("image_idx", "v").orderBy("u", "chain_id")
    o = t.obs.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return o.groupBy("chain_id").agg(F.countDistinct("image_idx").alias("images")).filter("images >= 3")


@query("v10_fast_slow", "with recursive o as (select k, event_id, x, row_number() over (partition by k order by t, event_id) as rn from series), y as (select k, event_id, rn, x as s, x as f from o where rn = 1 union all select o.k, o.event_id, o.rn, 0.04e0 * o.x + 0.96e0 * y.s, 0.5e0 * o.x + 0.5e0 * y.f from y join o on o.k = y.k and o.rn = y.rn + 1) select k, event_id, round((f - s) / (f + s + 1), 6) + 0e0 as diff from y")
def _(t):
    from ..operators.series import ewma

    s = t.series.select("k", "event_id", "x")
    both = ewma(ewma(s, ["k"], "event_id", "x", 0.04, "s"), ["k"], "event_id", "x", 0.5, "f")
    return both.select("k", "event_id", r((F.col("f") - F.col("s")) / (F.col("f") + F.col("s") + 1)).alias("diff"))


@query("v12_fourier", "with g as (select user_id % 5 as k, extract(hour from ts) as h, avg(value) as x from events group by all), m as (select h.k, m.m, sum(x * cos(2 * pi() * m.m * h.h / 24)) / 12 as a, sum(x * sin(2 * pi() * m.m * h.h / 24)) / 12 as b from g h, (select unnest([1, 2, 3]) as m) m group by all) select k, m, round(a, 5) + 0e0 as a, round(b, 5) + 0e0 as b from m")
def _(t):
    """First coefficients of the daily cycle by quadrature over the hours."""
    g = t.events.groupBy((F.col("user_id") % 5).alias("k"), F.hour("ts").alias("h")).agg(F.avg("value").alias("x"))
    e = g.withColumn("m", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    phase = 2 * F.pi() * F.col("m") * F.col("h") / 24
    return e.groupBy("k", "m").agg(r(F.sum(F.col("x") * F.cos(phase)) / 12, 5).alias("a"), r(F.sum(F.col("x") * F.sin(phase)) / 12, 5).alias("b"))


@query("v13_cell_scores", "select least(7, floor(u / 500))::bigint as cx, least(5, floor(v / 500))::bigint as cy, max(id % 255) as hi, min(id % 255) as lo, count(*) as n, round(avg(id % 255), 5) as mean from uv where id % 5 <> 0 group by all")
def _(t):
    z = F.col("id") % 255
    g = t.uv.filter("id % 5 <> 0").groupBy(F.least(F.lit(7), F.floor(F.col("u") / 500)).alias("cx"), F.least(F.lit(5), F.floor(F.col("v") / 500)).alias("cy"))
    return g.agg(F.max(z).alias("hi"), F.min(z).alias("lo"), F.count("*").alias("n"), r(F.avg(z), 5).alias("mean"))


@query("v16_chain_error", "with k as (select chain_id, u, row_number() over (partition by chain_id order by u desc, image_idx) as rn from obs) select chain_id, round(u, 4) as worst from k where rn = 1")
def _(t):
    return t.obs.groupBy("chain_id").agg(r(F.max("u"), 4).alias("worst"))


@query("v17_tile_bounds", "with w as (select s_suppkey as id, 3000 + s_nationkey * 10 as w, 2000 + s_nationkey * 10 as h from supplier), i as (select unnest(range(4)) as i), j as (select unnest(range(4)) as j) select id, i, j, trunc(w * i / 4e0)::bigint as x0, trunc(w * (i + 1) / 4e0)::bigint as x1, trunc(h * j / 4e0)::bigint as y0, trunc(h * (j + 1) / 4e0)::bigint as y1 from w, i, j")
def _(t):
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    w = t.supplier.select(F.col("s_suppkey").alias("id"), (3000 + F.col("s_nationkey") * 10).alias("w"), (2000 + F.col("s_nationkey") * 10).alias("h")).withColumn("i", n).withColumn("j", n)
    cut = lambda s, k: (F.col(s) * k / 4.0).cast("long")
    return w.select("id", "i", "j", cut("w", F.col("i")).alias("x0"), cut("w", F.col("i") + 1).alias("x1"), cut("h", F.col("j")).alias("y0"), cut("h", F.col("j") + 1).alias("y1"))

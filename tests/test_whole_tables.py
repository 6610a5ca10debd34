"""Queries take whole tables; those without SQL against plain restatements."""

import duckdb
import numpy as np
import pytest

from skyloom.operators import geometry as geo
from skyloom.operators import graph
from skyloom.operators import series as ts
from skyloom.plans import registry
from skyloom.streaming import filters

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def users(spark):
    e = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("user_id as k", "event_id", "event_type", "unix_micros(cast(ts as timestamp)) / 1e6 as t", "value as x").toPandas()
    return dict(list(e.groupby("k")))


def walked(filt, g):
    out, s = {}, filt.start()
    for i, x in zip(g["event_id"], g["x"]):
        s, row = filt.step(s, float(i), x)
        if row is not None:
            out[i] = row
    return out


@pytest.mark.parametrize("name, filt", [("t09_streaming_modes", filters.StreamingModes()), ("t10_window_modes", filters.WindowModes())])
def test_modes_of_all_users(spark, users, name, filt):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert set(got["k"]) == set(users)
    for k in (0, 20, 149):
        want = walked(filt, users[k].sort_values("event_id"))
        mine = got[got["k"] == k].set_index("event_id")
        assert set(mine.index) == set(want)
        assert np.allclose(mine.loc[list(want), list(filt.columns)].to_numpy(), list(want.values()), atol=2e-6)


def test_smoothing_of_all_users(spark, users):
    got = registry.QUERIES["w11_butterworth"](spark, FOLDER).toPandas()
    assert len(got) == sum(map(len, users.values()))
    for k, g in got.groupby("k"):
        assert np.allclose(g.sort_values("event_id")["smooth"], ts.zero_phase(users[k].sort_values("event_id")["x"].to_numpy(), 0.2), atol=1e-6)


def test_splines_of_all_users(spark, users):
    got = dict(list(registry.QUERIES["v15_spline"](spark, FOLDER).toPandas().groupby("k")))
    assert set(got) == set(users)
    for k, g in users.items():
        assert len(got[k]) == g["t"].nunique() - 1


def test_alignment_of_all_users(spark, users):
    got = registry.QUERIES["j27_sequence_alignment"](spark, FOLDER).toPandas()
    want = set()
    for k, g in users.items():
        a, b = (sorted(g.loc[g["event_type"] == e, "t"]) for e in ("purchase", "view"))
        want |= {(k, i, j) for i, j in geo.align_sequences(a, b, 3600.0)}
    assert set(got.itertuples(index=False, name=None)) == want and max(k for k, _, _ in want) >= 30


def test_bundle_of_all_observations(spark):
    folder = "/root/testdata/sf0.001"
    got = registry.QUERIES["e12_bundle_adjustment"](spark, folder).toPandas().loc[0]
    o = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey", "l_suppkey").toPandas().drop_duplicates()
    assert tuple(got[["images", "features", "observations"]]) == (o["l_suppkey"].nunique(), o["l_partkey"].nunique(), len(o))
    assert got["before"] > 5 and got["after"] < 0.5


def test_groups_of_all_images(spark, tmp_path):
    o = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_partkey + 5000 as l_partkey", "l_suppkey * 100 + 70 as l_suppkey")
    o.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.group_id, r.image) for r in registry.QUERIES["g03_image_groups"](spark, str(tmp_path)).collect()}
    o = o.distinct().toPandas()
    ids = sorted(set(o["l_suppkey"]))
    chains = sorted(([ids.index(i) for i in sorted(g)] for _, g in sorted(o.groupby("l_partkey")["l_suppkey"])), key=lambda c: -len(c))
    groups, _ = graph.grow_groups(chains, len(ids))
    assert got == {(k, ids[i]) for k, g in enumerate(groups) for i in g} and got


def test_slopes_where_many_features_coincide(spark, tmp_path):
    keys = [k for j in range(14) for k in range(10 + 97 * 89 * j, 10 + 97 * 89 * j + 3)] + list(range(40, 60))
    spark.createDataFrame([(k, k % 50) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = dict(con.execute(registry.SQL["g07_neighbour_slopes"]).fetchall())
    got = {r.chain_id: r.slope for r in registry.QUERIES["g07_neighbour_slopes"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-5) and 10 in want


def test_planes_of_all_features(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.image_idx: r.z for r in registry.QUERIES["e14_plane_interpolation"](spark, folder).collect()}
    part = spark.read.parquet(f"{folder}/part.parquet").orderBy("p_partkey").collect()
    for s in spark.read.parquet(f"{folder}/supplier.parquet").collect():
        i = s.s_suppkey
        f = {}
        for p in part:
            if p.p_partkey % 40 // 10 == i % 4:
                f.setdefault((p.p_partkey % 97 * 3.0, p.p_partkey % 89 * 3.0), float(p.p_size))
        z = geo.plane_interpolate(np.array(list(f)), np.array(list(f.values())), np.array([[i % 10 * 30.0, i // 10 * 30.0]]))[0]
        assert (got[i] is None) == bool(np.isnan(z))
    assert any(z is not None for z in got.values())

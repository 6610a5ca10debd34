import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm.hard_negatives import Tree, ball_tree, mine, search
from skyloom.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, k=5, m=10, every=4):
    """All scores of every anchor, sorted."""
    good = {}
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, [math.floor(256 * float(np.float32(c))) for c in v])
        good[i] = min(good.get(i, x), x)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scores = sorted(((-sum(p * q for p, q in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a))
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            fit = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(a, p, rank, i, -s, -score) for rank, (score, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=4, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema)
    out = mine(df, F.col("vec_id") % every == 0, **kw)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def vectors(rng, n, dim=8, labels=4, clusters=6, spread=0.2):
    centres = rng.standard_normal((clusters, dim))
    v = centres[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), int(x), [float(c) for c in w.astype(np.float32)]) for i, (x, w) in enumerate(zip(rng.integers(labels, size=n), v))]


@pytest.mark.parametrize("tree_rows, block_rows", [(2048, 1024), (40, 16)])
def test_against_all_scores(spark, tree_rows, block_rows):
    rows = vectors(np.random.default_rng(1), 600)
    got = mined(spark, rows, tree_rows=tree_rows, block_rows=block_rows)
    assert got == brute(rows) and len(got) > 3000


def test_ties_a_hot_label_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 300, labels=9)
    rows += [(1000 + k, 7, rows[5][2]) for k in range(120)] + [(2000 + k, k % 2, rows[5][2]) for k in range(60)]
    rows += [(3000 + k, 3, [0.5] + [0.0] * 7) for k in range(30)] + [(4000 + k, 2, [0.25] + [0.0] * 7) for k in range(30)]
    assert mined(spark, rows, tree_rows=64, block_rows=32) == brute(rows)


def test_nulls_non_finite_repeats_empty_and_odd_lengths(spark):
    rows = vectors(np.random.default_rng(3), 120)
    odd = [(None, 1, rows[0][2]), (500, None, rows[0][2]), (504, 1, None), (508, 1, [None] * 8), (512, 1, [float("nan")] * 8), (516, 1, [float("inf")] * 8)]
    again = [rows[4], rows[4], (8, 0, rows[9][2])]  # repeated rows, and another row of id 8
    want = brute(rows + odd + again)
    assert mined(spark, rows + odd + again + [(520, 1, []), (524, 1, [0.1] * 3)], dim=8) == want
    assert mined(spark, rows + odd + again + [(520, 1, []), (524, 1, [0.1] * 3)]) == want
    assert mined(spark, []) == [] and mined(spark, odd) == []
    assert mined(spark, [r for r in rows if r[0] % 4]) == []


def test_large_components_are_exact_and_beyond_64_bits_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(np.float32(x)) for x in rng.uniform(-2e6, 2e6, 4)]) for i in range(80)]
    assert mined(spark, rows + [(400, 1, [3e38] * 4)]) == brute(rows)


def test_columns_of_clashing_names(spark):
    rows = vectors(np.random.default_rng(5), 100)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", id int, tree string, score double")
    got = mine(df, F.col("vec_id") % 4 == 0).collect()
    assert sorted(map(tuple, ((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got))) == brute(rows)


def tree(rows, leaf):
    ids, labels, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.floor(256 * np.array([r[2] for r in rows])).astype(np.int32)
    order, nodes, centres, radii = ball_tree(v.astype(float), labels, leaf)
    return Tree({"ids": ids[order], "labels": labels[order], "v": v[order].tobytes(), "nodes": nodes.tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes()}, v.shape[1])


def test_intervals_prune_groups_of_anchors():
    rows = vectors(np.random.default_rng(6), 4000, clusters=8, spread=0.03, labels=2)
    a, c = tree(rows[:400], 16), [tree(rows[k : k + 1000], 32) for k in range(0, 4000, 1000)]
    best, scored = search(a, c, 5, None)
    assert scored < 0.3 * 400 * 4000 and len(best.slot) == 400 * 5
    assert all(n[2] < 0 or set(range(*a.nodes[n[2]][:2])) | set(range(*a.nodes[n[3]][:2])) == set(range(*n[:2])) for n in a.nodes)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(SQL["op13_hard_negatives"]).fetchdf()
    columns = sorted(want.columns)
    got = QUERIES["op13_hard_negatives"](spark, folder).toPandas()
    assert sorted(got.columns) == columns and sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None)) and len(got) > 900

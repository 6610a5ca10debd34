"""Pairs of images against plain loops, and that equal ones meet where they are made."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from skyloom.operators import joins
from skyloom.operators.pairs import image_pairs, pair_counts


def test_pairs_of_chains_are_whole_and_meet_in_a_task(spark, monkeypatch):
    r = random.Random(4)
    chains = {c: r.sample(range(-5, 40), r.randrange(1, 20)) for c in range(200)}
    obs = spark.createDataFrame([(c, i, float(c), i * 2.0) for c, m in chains.items() for i in m], "c long, i long, f double, w double")
    want = Counter(p for m in chains.values() for p in combinations(sorted(m), 2))
    assert {(x.i, x.j): x.n for x in pair_counts(obs, "c", "i").collect()} == want
    rows = image_pairs(obs, "c", "i", ["w"], ["f"], {"s": lambda o: o["w"] + F.col("f")}, block=7)
    got = rows.select("c", "i", "j", "x.s", F.col("y.w").alias("w"), F.spark_partition_id().alias("p")).collect()
    assert Counter((x.i, x.j) for x in got) == want and len({(x.c, x.i, x.j) for x in got}) == len(got)
    assert all(x.s == 2 * x.i + x.c and x.w == 2 * x.j for x in got)
    # a hash of chains would leave nearly every pair in every task
    assert len({(x.i, x.j, x.p) for x in got}) < 2 * len(want)


def test_nearest_meets_places_not_rows(spark, monkeypatch):
    rows = [(k, float(k % 6 * 10), float(k % 4 * 10)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    met, within = [], joins.within

    def counted(left, right, *rest):
        met.append(left.count() * right.count())
        return within(left, right, *rest)

    monkeypatch.setattr(joins, "within", counted)
    got = Counter()
    for x in joins.nearest(df, df, "id", "id", "x", "y", 10.0, k=3).collect():
        got[x.id, x["rank"], x.id_2, round(x.dist, 9)] += 1
    want = Counter()
    for i, x, y in rows:
        near = sorted((round(((x - u) ** 2 + (y - v) ** 2) ** 0.5, 9), j) for j, u, v in rows)[:3]
        want.update((i, n + 1, j, d) for n, (d, j) in enumerate(near))
    assert got == want and max(met) <= 12 * 36


def test_slots_hold_pairs_whole(spark, monkeypatch):
    from skyloom.operators import pairs

    monkeypatch.setattr(pairs, "TASK", 300)
    monkeypatch.setattr(pairs, "TOGETHER", 50)
    monkeypatch.setattr(pairs, "PACKED", 64)
    r = random.Random(6)
    chains = {c: r.sample([*range(-5, 40), 10**15, -(10**15)], r.randrange(1, 20)) for c in range(200)}
    rows = [(c, i) for c, m in chains.items() for i in m]
    obs = spark.createDataFrame([*rows, *rows[:50], (None, 3), (4, None)], "c long, i long")
    want = Counter(p for m in chains.values() for p in combinations(sorted(m), 2))
    got = pair_counts(obs, "c", "i", block=7)
    assert sorted(map(tuple, got.collect())) == sorted((*p, n) for p, n in want.items())
    # a pair is whole where it is made: nothing behind that exchanges it
    assert "HashAggregate(keys=[i" not in got._jdf.queryExecution().toString()
    ends = [(k, n) for p, n in want.items() for k in p]
    assert {(x.i, x.degree, x.weight) for x in pairs.degrees(obs, "c", "i", block=7).collect()} == {(i, sum(k == i for k, _ in ends), sum(n for k, n in ends if k == i)) for i in dict(ends)}
    o = spark.createDataFrame([(c, i, i % 64 * 0.5) for c, i in rows], "c long, i long, w double")
    off = lambda x, y: x[0] - y[0]
    tallied = pairs.pair_tallies(o, "c", "i", o, "i long, j long, n long, mean double, squares double, least double", lambda *x: [x], ["w"], off, block=7)
    assert all(x.n == want[x.i, x.j] and x.mean == x.least == (x.i % 64 - x.j % 64) * 0.5 and x.squares == 0 for x in tallied.collect())
    made = pairs.chain_pairs(o, "c", "i", ["w"], "d double", lambda x, y: (off(x, y) < -1, [off(x, y)[off(x, y) < -1]]), len(rows))
    assert Counter((x.i, x.j) for x in made.collect()) == Counter({p: n for p, n in want.items() if p[1] % 64 - p[0] % 64 > 2})
    assert pair_counts(obs.limit(0), "c", "i").isEmpty() and pairs.chain_pairs(o.limit(0), "c", "i", [], "", lambda x, y: (None, []), 0).isEmpty()

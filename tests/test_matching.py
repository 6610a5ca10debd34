"""The matcher's votes: planted motions under turns, and against a plain count."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyloom.operators.matching import RING, match_pairs, two_nearest, voted

SIZE = (4000.0, 3000.0)


def planted(seed, degrees, good=1500, bad=500):
    """Matches that one turn about the middle and a step make, and others at random."""
    r = random.Random(seed)
    a = math.radians(degrees)
    rows = []
    while len(rows) < good:
        u, v = r.uniform(0, SIZE[0]), r.uniform(0, SIZE[1])
        x, y = u - SIZE[0] / 2, v - SIZE[1] / 2
        p, q = SIZE[0] / 2 + x * math.cos(a) - y * math.sin(a) + 120, SIZE[1] / 2 + x * math.sin(a) + y * math.cos(a) + 40
        if 0 <= p < SIZE[0] and 0 <= q < SIZE[1]:
            rows.append((1, len(rows), u, v, p, q))
    return rows + [(1, good + k, *(r.uniform(0, SIZE[c % 2]) for c in range(4))) for k in range(bad)]


FIELDS = "pair int, i int, u1 double, v1 double, u2 double, v2 double"


def kept(spark, rows, **kw):
    return {r.i for r in voted(spark.createDataFrame(rows, FIELDS), "pair", SIZE, **kw).collect()}


def test_a_turned_image_keeps_what_a_level_one_keeps(spark):
    shares = {}
    for degrees in (0, 180, 90, 45):
        got = kept(spark, planted(7, degrees))
        shares[degrees] = sum(i < 1500 for i in got) / 1500
        assert sum(i >= 1500 for i in got) < 25
    assert shares[0] > 0.97 and shares[180] > 0.97 and shares[90] > 0.9 and shares[45] > 0.8, shares


def brute(rows, grid, factor):
    """Votes counted motion by motion."""
    w, h = SIZE[0] / grid, SIZE[1] / grid
    by_turn = {t: set() for t in range(8)}
    for x, y in ((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)):
        at = {i: (math.floor(a / w + x), math.floor(b / h + y), math.floor(c / w), math.floor(d / h)) for _, i, a, b, c, d in rows}
        n, cells = Counter(at.values()), Counter(c[:2] for c in at.values())
        for (a, b, c, d), own in n.items():
            mean = (cells[a, b] + sum(cells[a + p, b + q] for p, q in RING)) / 9
            for t in range(8):
                s = own + sum(n[a + RING[k][0], b + RING[k][1], c + RING[(k + t) % 8][0], d + RING[(k + t) % 8][1]] for k in range(8))
                if s > factor * math.sqrt(mean):
                    by_turn[t] |= {i for i, x_ in at.items() if x_ == (a, b, c, d)}
    return max(by_turn.values(), key=len)


@pytest.mark.parametrize("seed, degrees", [(1, 0), (2, 90), (3, 200)])
def test_votes_against_a_plain_count(spark, seed, degrees):
    rows = planted(seed, degrees, 150, 60)
    assert kept(spark, rows, grid=8, factor=1.5) == brute(rows, 8, 1.5)


def test_no_matches_give_no_votes(spark):
    assert kept(spark, []) == set()


def test_matches_of_an_image_that_came_back_turned(spark):
    """Keypoints with descriptors: the opposite heading keeps what the same heading keeps."""
    r = random.Random(5)
    found = {}
    for degrees in (0, 180):
        rows = planted(9, degrees, 700, 0)
        vec = [[r.gauss(0, 1) for _ in range(8)] for _ in rows]
        left = spark.createDataFrame([(1, i, vec[i], u, v) for _, i, u, v, _, _ in rows], "pair int, id int, vec array<double>, u double, v double")
        right = spark.createDataFrame([(1, 1000 + i, [x + r.gauss(0, 0.01) for x in vec[i]], u, v) for _, i, _, _, u, v in rows], left.schema)
        got = match_pairs(left, right, "pair", limit=1.0, size=SIZE).collect()
        assert all(x.j == 1000 + x.i for x in got)
        found[degrees] = len(got)
    assert min(found.values()) > 600 and abs(found[0] - found[180]) < 40, found


def test_two_nearest_against_all_distances(spark):
    r = random.Random(6)
    rows = [(k % 2, k, [float(r.randrange(3)) for _ in range(4)]) for k in range(160)]
    df = spark.createDataFrame(rows, "g int, id int, vec array<double>")
    got = {(x.i, x.rn): (x.j, x.d) for x in two_nearest(df, df, "g", tile=16, apart=True).collect()}
    for g, i, v in rows:
        want = sorted((math.dist(v, w), j) for h, j, w in rows if h == g and j != i)[:2]
        assert [got[i, k] for k in (1, 2)] == [(j, d) for d, j in want]
    assert two_nearest(df.filter("id < 2"), df.filter("id < 2"), "g", apart=True).count() == 0
    assert two_nearest(df.filter(F.col("id") < 4), df.filter("id < 4"), "g", apart=True).count() == 4

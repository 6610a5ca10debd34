import random

import pytest

from skyloom.llm import jaccard_join as j


def brute(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids, parent = [i for i, _ in rows], {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(rng.choice(vocab) for _ in range(40))
    for k in range(40):
        rows.append((k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 90))) + (" " + passage if k % 2 else "")))
    base = " ".join(rng.choice(vocab) for _ in range(80)).split()
    for k in range(100, 150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    chain = [rng.choice(vocab) for _ in range(60)]
    for k in range(200, 215):
        chain = chain[1:] + [rng.choice(vocab)]
        rows.append((k, " ".join(chain)))
    return rows + [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "One  TWO"), (305, "x"), (306, rows[5][1].upper())]


@pytest.mark.parametrize("hot, slack, block, sent", [(128, 16, 1024, 500_000), (4, 3, 8, 500_000), (4, 3, 8, 0)])
def test_exact_components(spark, monkeypatch, hot, slack, block, sent):
    for name, v in (("HOT", hot), ("SLACK", slack), ("BLOCK", block), ("HOT_SENT", sent)):
        monkeypatch.setattr(j, name, v)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 9, "c") for i, t in rows], "doc_id long, text string, n int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.component_ids(df, size=4, num=85, den=100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_rows_and_columns_stay(spark):
    text = " ".join(f"v{k}" for k in range(30))
    df = spark.createDataFrame([(2, text, "a"), (1, text, "b"), (2, text, "c"), (None, text, "d"), (5, None, "e")], "doc_id long, text string, key string")
    out = j.near_duplicates(df)
    assert out.columns == ["doc_id", "text", "key", "component_id"]
    assert {r.key: r.component_id for r in out.collect()} == {"a": 1, "b": 1, "c": 1, "d": None, "e": 5}
    assert j.near_duplicates(df.limit(0)).count() == 0


def test_bounds_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 300)))
        keep = a[rng.random(len(a)) < 0.95]
        b = np.unique(np.concatenate([keep, rng.integers(-(2**62), 2**62, rng.integers(0, 10))]))
        if len(b) and j.links(a, b, 85, 100):
            assert j.may_link(len(a), j.bitmap(a), len(b), j.bitmap(b), 85, 100)
            assert j.block_links([(1, 1, a)], [(2, 2, b)], 85, 100) == [(1, 2)]


def test_documents_of_one_template_make_no_tiles(spark, monkeypatch):
    monkeypatch.setattr(j, "HOT", 8)
    seen = []
    large = j.large_tile_links
    monkeypatch.setattr(j, "large_tile_links", lambda docs, reps, rows, *a: (seen.append(rows.count()), large(docs, reps, rows, *a))[1])
    rng = random.Random(3)
    template = [f"t{k}" for k in range(90)]
    rows = [(k, " ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(10)])) for k in range(60)]
    rows += [(100 + k, " ".join([*rows[k][1].split()[:-1], "end"])) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.component_ids(df, size=4, num=85, den=100).collect()}
    assert got == brute(rows, 4, 85, 100) and got[100][1] == 0 and seen == [0]


def test_very_long_texts(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "other " * 100_000), (4, "x" * 2_000_000)]
    got = {r.doc_id: r.component_id for r in j.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}

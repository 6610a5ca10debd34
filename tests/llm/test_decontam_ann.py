import random

import numpy as np

from skyloom.llm.ann import nearest
from skyloom.llm import decontam
from skyloom.llm.decontam import GAP, MATCH, MISMATCH, Seeds, align, contaminated, find, words


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for k in range(1, len(b) + 1):
            s = MATCH if a[i - 1] == b[k - 1] else MISMATCH
            h[i][k] = max(0, h[i - 1][k - 1] + s, h[i - 1][k] + GAP, h[i][k - 1] + GAP)
            best = max(best, h[i][k])
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        s, i, k = align(np.array(a), np.array(b))
        assert s == brute_align(a, b) and (s == 0 or a[i - 1] == b[k - 1])


def test_copies_are_caught_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, say(rng.randrange(15, 50))) for k in range(20)]
    docs, want = [], set()
    for d in range(120):
        w = say(rng.randrange(5, 200))
        if d % 4 == 0:
            i, x = items[rng.randrange(20)]
            y = list(x)
            if d % 8 == 0:
                for _ in range(len(y) // 8):
                    y[rng.randrange(len(y))] = "edited"
                y.insert(len(y) // 2, "extra")
            at = rng.randrange(len(w) + 1)
            w = w[:at] + y + w[at:]
            want.add((d, i))
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (None, " ".join(items[0][1])), (502, "!!! ...")]
    bench = [(i, " ".join(x).upper()) for i, x in items] + [(90, None), (91, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (20_000, 7):
        got = contaminated(df, b, item_block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    r = got[0]
    text = dict(docs)[r.doc_id]
    assert r.score >= 0.5 and len(words(text)) >= r.doc_end > r.doc_start
    assert contaminated(df.limit(0), b).count() == 0 and contaminated(df, b.limit(0)).count() == 0


def test_edited_copies_in_many_documents_are_caught(spark):
    rng = random.Random(5)
    item = [f"x{k}" for k in range(30)]
    edited = [w if k not in (7, 15, 23) else f"other{k}" for k, w in enumerate(item)]
    say = lambda: [f"w{rng.randrange(300)}" for _ in range(40)]
    copies = {"edited": edited, "cut": item[:21]}
    for y in copies.values():
        docs = [(d, " ".join(say() + y + say())) for d in range(20)] + [(d, " ".join(say())) for d in range(20, 40)]
        got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
        assert sorted(r.doc_id for r in got) == list(range(20))
        assert all(abs(r.score - brute_align(item, y) / (MATCH * len(item))) < 1e-9 for r in got)


def edits(rng, item, vocab):
    kind, out = rng.randrange(4), []
    for k, x in enumerate(item):
        if kind == 0 and k % 3 == 2:
            out.append(rng.choice(vocab))
        elif kind == 1 and k % 2:
            out += [x, rng.choice(vocab)]
        elif kind == 2 and rng.random() < 0.3:
            out += rng.choice([[], [rng.choice(vocab)], [x, rng.choice(vocab)]])
        else:
            out.append(x)
    return out


def test_seeds_miss_no_alignment_that_scores_enough(monkeypatch):
    rng = random.Random(8)
    for common in (decontam.COMMON, 1):
        monkeypatch.setattr(decontam, "COMMON", common)
        vocab = [f"w{k}" for k in range(60)]
        items = [(k, words(" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40))))) for k in range(40)]
        raw = {k: rng.sample(vocab, 30)[: rng.randrange(3, 30)] for k in range(40, 80)}
        items += [(k, words(" ".join(x))) for k, x in raw.items()]
        seeds, hit = Seeds(items, 0.5), 0
        for _ in range(150):
            body = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
            at = rng.randrange(len(body) + 1)
            w = words(" ".join(body[:at] + edits(rng, raw[rng.randrange(40, 80)], vocab) + body[at:]))
            want = {i: s / (MATCH * len(x)) for i, x in items if len(w) and (s := align(x, w)[0]) >= MATCH * len(x) / 2}
            got = {i: s for i, s, *_ in find(seeds, w)}
            assert got == want
            hit += len(want)
        assert hit > 100


def test_every_document_against_every_item(spark):
    """Recall over all pairs of the smallest tables, whole texts: 1."""
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs, bench).collect()}
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        w = words(r.text)
        for i, x in items:
            if len(x) and np.isin(x, w).mean() >= 0.5:
                s = align(x, w)[0] / (MATCH * len(x))
                if s >= 0.5:
                    want[r.doc_id, i] = s
    assert got == want and want


def test_short_items_and_very_long_texts(spark):
    bench = spark.createDataFrame([(1, "alone"), (2, "two words"), (3, "now three words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "all alone here"), (2, "words two"), (3, "two words"), (4, "filler " * 300_000 + "Now three, words"), (5, "x" * 3_000_000)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(1, 1), (3, 2), (4, 3)}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 24))
    v = [(centres[k % 8] + 0.4 * rng.normal(size=24)).tolist() for k in range(900)]
    rows = [(k, x, 1) for k, x in enumerate(v)] + [(2000 + k, v[50], 1) for k in range(8)]
    odd = [(3000, None, 1), (3050, [0.0] * 24, 1), (3100, [float("nan")] * 24, 1), (3150, [None] + [1.0] * 23, 1), (3200, [float("inf")] * 24, 1), (3250, [1.0] * 5, 1), (None, v[0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id int").repartition(4)
    out = nearest(df, df.filter("vec_id % 50 = 0"), query_block=9).collect()
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    n = np.sqrt((m * m).sum(axis=1))
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        at = int(np.flatnonzero(ids == q)[0])
        c = (m @ m[at]) / n / n[at]
        c[at] = -9
        want = ids[np.lexsort((ids, -np.round(c, 12)))[:5]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        hit += len(set(want) & {x[1] for x in mine})
        total += 5
    assert hit >= 0.97 * total and {r.query_id for r in out} <= set(ids.tolist())
    same = sorted((r.rank, r.vec_id) for r in out if r.query_id == 50)
    assert [i for _, i in same] == [2000, 2001, 2002, 2003, 2004]
    assert nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 50, 51)")
    assert nearest(few, few.filter("vec_id = 0")).count() == 2


def test_one_plan_for_any_number_of_queries(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(600)], "vec_id long, embedding array<double>")
    plans = [nearest(df, df.filter(f"vec_id % {n} = 0"), query_block=10, tile_rows=100) for n in (50, 2)]
    size = [len(p._jdf.queryExecution().optimizedPlan().toString().splitlines()) for p in plans]
    assert size[0] == size[1]
    whole = {(r.query_id, r.rank): r.vec_id for r in nearest(df, df.filter("vec_id % 2 = 0")).collect()}
    assert {(r.query_id, r.rank): r.vec_id for r in plans[1].collect()} == whole and len(whole) == 1500


def test_queries_of_one_id_are_the_smallest_vector(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(0, 1, 6).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, rows[7][1]), (7, [9.0] * 6), (7, [-9.0, *rows[9][1][1:]])], df.schema)
    one = spark.createDataFrame([(7, min(rows[7][1], [9.0] * 6, [-9.0, *rows[9][1][1:]]))], df.schema)
    assert sorted(nearest(df, asked, k=4).collect()) == sorted(nearest(df, one, k=4).collect())

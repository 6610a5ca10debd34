import itertools
import random
import zlib

import numpy as np

from skyloom.llm.line_crf import WIDTH, Crf, line_features, score_quality
from skyloom.llm.toxicity import SURE, choose_words, corrected_risk, score_toxicity, word_keys


def texts(rng, n, bad):
    vocab = ["the", "river", "runs", "quietly", "through", "old", "stone", "bridges", "while", "children", "play", "nearby"]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(4, 14))).capitalize() + "." for _ in range(rng.randrange(2, 6))]
        out.append("\n".join(" ".join(w.upper() + "!!" for w in x.split()) if bad else x for x in lines))
    return out


def test_quality_on_held_out(spark):
    rng = random.Random(1)
    rows = [(k, t, 1) for k, t in enumerate(texts(rng, 60, False))] + [(100 + k, t, 0) for k, t in enumerate(texts(rng, 60, True))]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (None, rows[0][1], "s"), (0, rows[0][1], "s"), (902, "long words. " * 20000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = score_quality(docs, labels).collect()
    assert len(out) == 125 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert score_quality(docs.limit(0), labels).count() == 0
    assert score_quality(docs.limit(2), labels.limit(0)).count() == 2


def test_features_have_a_row_for_each_line():
    for t in (None, "", "\n\n", "a\nb c\n", "é中 x"):
        x, chars = line_features(t)
        assert len(x) == len(chars) == len((t or "").split("\n"))


def test_toxicity_on_held_out(spark):
    rng = random.Random(2)
    rows = []
    for k in range(240):
        t = texts(rng, 1, False)[0]
        bad = k % 4 == 0
        rows.append((k, t.replace("river", rng.choice(["nastyword", "foulterm"])) + (" Nastyword!" if bad else "") if bad else t, int(bad)))
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(900, None, 1), (901, "", 1), (None, "x", 1), (7, rows[7][1], 1)], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    none = score_toxicity(docs, labels.filter("toxic = 0")).collect()
    assert not any(r.predicted for r in none)
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(4)
    for n in range(1, 8):
        crf = Crf(rng.normal(size=WIDTH), rng.random(WIDTH) + 0.5, rng.normal(size=WIDTH) / WIDTH, rng.normal(size=(2, 2)), 1.0, 0.0)
        x = rng.normal(size=(n, WIDTH))
        u = ((x - crf.mean) / crf.spread) @ crf.weights
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            mass = np.exp(sum(u[k] for k in range(n) if y[k]) + sum(crf.pair[a, b] for a, b in zip(y, y[1:])))
            total += mass
            good += mass * np.array(y)
        assert np.allclose(crf.good(x), good / total, atol=1e-9)


def test_risk_gradient_against_differences():
    rng = np.random.default_rng(5)
    signs = set()
    for shift in (-1.0, 0.0, 3.0):
        p = np.arange(12) < 5
        f = rng.normal(size=12) + np.where(p, shift, -shift)
        value, g = corrected_risk(f, p, 0.6)
        signs.add(np.logaddexp(0, f[~p]).mean() < 0.6 * np.logaddexp(0, f[p]).mean())
        for k in range(12):
            step = np.zeros(12)
            step[k] = 1e-6
            d = (corrected_risk(f + step, p, 0.6)[0] - corrected_risk(f - step, p, 0.6)[0]) / 2e-6
            assert abs(d - g[k]) < 1e-6
    assert signs == {True, False}


def test_words_are_chosen_from_all_texts(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "vile" if k % 5 == 0 else "delta"]) for _ in range(12))) for k in range(300)]
    docs = spark.createDataFrame([*rows, (900, None)], "id long, text string").repartition(4)
    toxic = spark.createDataFrame([(k,) for k in range(0, 300, 5)], "id long")
    got = set(choose_words(docs, toxic, 1000).tolist())
    keys = {k: word_keys(t) for k, t in [*rows, (900, None)]}
    want, n_u, n_p = set(), 301, 60
    for w in set().union(*keys.values()):
        u, p = sum(w in x for x in keys.values()), sum(w in keys[k] for k in range(0, 300, 5))
        rate = (u + p) / (n_u + n_p)
        if abs(p / n_p - u / n_u) >= SURE * (max(rate * (1 - rate), 1e-9) * (1 / n_u + 1 / n_p)) ** 0.5:
            want.add(w)
    assert got == want and len(choose_words(docs, toxic, 2)) == 2

import hashlib
import random

import numpy as np
import pytest

from skyloom.llm.prefix_hash import BASES, MOD, WINDOW, Hashed, common_spans, compared, edited, edited_fingerprints, judged, likeness

SCHEMA = "doc_id long, text string"


def plain(text):
    """The fingerprint by Horner's rule backwards, with Python integers."""
    out = []
    for b in BASES:
        x = 0
        for c in reversed(text):
            x = (x * b + ord(c) + 1) % MOD
        out.append(f"{x:08x}")
    return f"{len(text):x}:" + "".join(out)


def sentence(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(999)) for _ in range(n))


def test_values_spans_and_extensions_against_slices():
    r = random.Random(1)
    for _ in range(60):
        a, b = ("".join(r.choice("ab" if _ % 2 else "aé漢😀") for _ in range(r.randrange(0, 90))) for _ in range(2))
        b = b[:20] + a[: r.randrange(90)] + b[20:]
        x, y = Hashed.of(a), Hashed.of(b)
        assert x.fingerprint() == plain(a) and y.fingerprint() == plain(b)
        for _ in range(20):
            i, j = r.randrange(len(a) + 1), r.randrange(len(b) + 1)
            n = r.randrange(min(len(a) - i, len(b) - j) + 1)
            assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
            f = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
            g = next((k for k in range(min(i, j)) if a[i - k - 1] != b[j - k - 1]), min(i, j))
            assert (x.forward(i, y, j), x.backward(i, y, j)) == (f, g)


def test_joined_text_has_the_arrays_and_windows_of_the_whole():
    r = random.Random(2)
    for n, m in ((0, 0), (1, 3), (30, 50), (400, 10), (10, 700), (300, 300), (65, 900)):
        a, b = sentence(r, n)[:n], sentence(r, m)[:m]
        x, y = Hashed.of(a), Hashed.of(b)
        for keep, take in ((n - n // 3, min(m, n // 3)), (n, m), (0, m), (n, 0)):
            got, want = x.joined(keep, y, take), Hashed.of(a[:keep] + b[:take])
            assert np.array_equal(got.values, want.values)
            assert all(np.array_equal(p, q) for p, q in zip(got.windows, want.windows))


def test_spans_are_common_and_likeness_follows_edits():
    r = random.Random(3)
    for _ in range(40):
        a = sentence(r, 150)
        words = a.split()
        for k in range(0, 150, 40):
            words[k] = "edited"
        near, far, moved = " ".join(words), sentence(r, 150), a[600:] + a[:600]
        x = Hashed.of(a)
        for other in (near, far, moved, a[:500], a + sentence(r, 50)):
            y = Hashed.of(other)
            for i, j, n in common_spans(x, y):
                assert n > 0 and a[i : i + n] == other[j : j + n]
        scores = [likeness(x, Hashed.of(t)) for t in (a, near, moved, far)]
        assert scores[0] == 1 and scores[1] > 0.85 and scores[2] > 0.85 and scores[3] < 0.1
        assert likeness(Hashed.of(near), x) == pytest.approx(scores[1], abs=0.05)
    for a, b, want in (("", "", 1), ("", "x", 0), ("x", "x", 1), ("aaaa", "aa", 1), ("abc", "abd", 2 / 3), ("ab", "ba", 0)):
        assert likeness(Hashed.of(a), Hashed.of(b)) == pytest.approx(want)


def brute(docs):
    """Next document, edited text and digests by sorting all rows."""
    last = sorted((d for d in docs if d[0] is not None), key=lambda d: -d[0]) + [d for d in docs if d[0] is None]
    out = []
    for k, (i, text) in enumerate(last):
        text, following = text or "", last[(k + 1) % len(last)][1] or ""
        new = edited(text, following)[0]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), plain(text), plain(new), likeness(Hashed.of(text), Hashed.of(new)), likeness(Hashed.of(text), Hashed.of(following)), new))
    return out


def found(df, **kw):
    out = edited_fingerprints(df, **kw)
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.edited_text) for r in out.collect()]


def test_against_sorting_all_rows(spark):
    r = random.Random(4)
    docs = [(k * 3 - 100, sentence(r, r.randrange(0, 120))) for k in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "x"), (1003, "é漢😀 " * 30), (1004, sentence(r, 60_000)), (1005, docs[7][1]), (1006, docs[7][1]), (None, "no id")]
    r.shuffle(docs)
    want = brute(docs)
    assert sorted(found(spark.createDataFrame(docs, SCHEMA)), key=str) == sorted(want, key=str)
    by = {w[0]: w for w in want}
    assert by[1005][3] == by[1006][3] == by[-79][3] and by[1006][6] == 1 and len({w[3] for w in want}) == len({t or "" for _, t in docs})
    # the next document is short: two thirds are kept, and nearly nothing is put in their place
    assert by[1004][5] == pytest.approx(0.8, abs=0.01)


def test_one_row_empty_table_repeats_and_clashing_columns(spark):
    one = found(spark.createDataFrame([(1, "abcdef")], SCHEMA))
    assert one == brute([(1, "abcdef")]) and one[0][7] == "abcdab"
    assert found(spark.createDataFrame([], SCHEMA)) == []
    same = spark.createDataFrame([(1, "abcdef", 3, "q", 4)] * 40, SCHEMA + ", part int, edge string, id int")
    got = found(same)
    assert got == one * 40 and got[0][6] == 1
    three = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c")], SCHEMA)
    assert found(three.repartition(3)) == found(three.coalesce(1))


def test_compared_columns_keep_rows_and_spans(spark):
    r = random.Random(5)
    a = sentence(r, 80)
    df = spark.createDataFrame([(1, a, a[100:] + "tail"), (2, None, "x"), (3, None, None)], "likeness long, left string, right string")
    rows = {(x.left, x.right): x for x in compared(df).collect()}
    x = rows[a, a[100:] + "tail"]
    assert x.left_fingerprint == plain(a) and x.likeness > 0.9 and max(s.length for s in x.spans) == len(a) - 100
    assert rows[None, "x"].likeness == 0 and rows[None, None].likeness == 1 and len(rows) == 3


def test_windows_are_a_steady_share():
    text = sentence(random.Random(6), 20_000)
    n = len(Hashed.of(text).windows[0])
    assert 0.04 < n / (len(text) - WINDOW) < 0.09
    assert judged(text, Hashed.of(text), "", Hashed.of(""))["edited_text"] == text[: len(text) - len(text) // 3]

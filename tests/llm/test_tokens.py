import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skyloom.llm import packing
from skyloom.llm.token_files import TokenFile, read_token_files, write_token_files
from skyloom.llm.tokens import Encoder, default_path

TEXTS = ["", "Hello  world\n\n don't", "été | x", "a", "<|endoftext|> b", " lead", "trail \n", "tabs\t\tand nbsp", "word " * 3000]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_path())


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def test_encoder_gives_the_library_ids(tok):
    e, rng = Encoder(default_path()), random.Random(1)
    parts = ["a", "word", "Word,", " ", "  ", "\n", "\n\n", "\t", "\xa0", "é", "中", "12", ".", "'s", "don't", "!!", "<|endoftext|>", " \n", "\r\n", "ñ", "\x1c", "\x85", " ", "ʼn"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert np.frombuffer(e.encode(s), e.dtype).tolist() == tok.encode(s, add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark, tok):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (None, "null id"), (1, TEXTS[1])] + [(200 + k, "tail words " * (k % 37)) for k in range(200)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int").coalesce(1)
    out = packing.pack(df).toPandas()
    per = out.groupby("sequence_id")
    assert per.length.sum().max() <= 1024 and per.size().max() <= packing.MAX_SEGMENTS
    assert all(g.sort_values("offset").offset.tolist() == [0, *g.sort_values("offset").length.cumsum().tolist()[:-1]] for _, g in per)
    assert out.length.sum() == sum(len(ids_of(tok, t)) for _, t in rows)
    for i, t in rows:
        if i is None or i == 1:
            continue
        ids, mine = ids_of(tok, t), out[out.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]] and set(mine.doc_tokens) == {len(ids)}
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    assert (per.length.sum() < 1024).sum() <= 1


def test_limits_hold_together():
    rng = np.random.default_rng(0)
    def examples():
        for k in range(500):
            n = int(rng.integers(1, 90))
            yield k, np.arange(n), rng.random(n) < 0.4
    limits = (100, 4, 30)
    seen = {}
    for seq in packing.pack_stream(examples(), limits):
        assert 0 < sum(len(p.ids) for p in seq) <= 100 and len(seq) <= 4 and sum(p.key()[1] for p in seq) <= 30
        for p in seq:
            seen.setdefault(p.example, []).append((p.start, len(p.ids)))
    assert len(seen) == 500
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) for v in seen.values())


def test_whole_examples_without_cutting():
    seqs = list(packing.pack_stream(((k, np.zeros(60), None) for k in range(10)), (100, 8, 100), cut=False))
    assert len(seqs) == 10
    with pytest.raises(ValueError):
        list(packing.pack_stream(iter([(0, np.zeros(101), None)]), (100, 8, 100), cut=False))


def test_loss_column_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", True), (2, "d e f", None)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r.loss_tokens for r in packing.pack(df, loss_col="learn").collect()}
    assert got == {1: 4, 2: 0}
    assert packing.pack(df.limit(0)).count() == 0


def test_token_files_round_trip(spark, tok, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (None, "null id"), (4, "twice"), (4, "twice")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, file string")
    m = write_token_files(df, str(tmp_path / "t"), files=3, length=64)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, m).collect()))
    at = 0
    for (s, i, n, c), (wi, wt) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        ids = ids_of(tok, wt)
        assert (s, i, n, c) == (at, wi, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    for r in m.collect():
        f = TokenFile(r.file)
        whole = np.concatenate([f.batch(k) for k in range(f.batches())])
        n = len(whole) // 64
        assert all((f.sequence(k) == whole[k * 64 : k * 64 + 64]).all() for k in range(n))
        assert sum(int(f.mask(k).sum()) for k in range(n)) == r.n_tokens
        lo, size = f.source.read_buffer(f.source.size()).address if f.source.seek(0) == 0 else 0, f.source.size()
        for view in (f.batch(0), f.sequence(0), f.mask(n - 1)):
            assert not view.flags.owndata and lo <= view.ctypes.data < lo + size
        f.close()


def test_token_files_of_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    m = write_token_files(df, str(tmp_path / "t"))
    assert m.count() == 0 and read_token_files(spark, m).count() == 0


def test_limits_bind_one_by_one_on_conversations(spark, tok):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").coalesce(1)
    limits = {"max_tokens": 512, "max_segments": 6, "max_loss": 200}
    out = packing.pack_conversations(turns, **limits).toPandas()
    want = {}
    for r in turns.orderBy("conv_id", "turn", "role", "text").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        a, b = want.get(r.conv_id, (1, 0))
        want[r.conv_id] = (a + n, b + n * (r.role == "assistant"))
        last = r.role == "assistant"
        want[r.conv_id, "end"] = last
    got = out.groupby("conv_id").agg(n=("length", "sum"), loss=("loss_tokens", "sum"))
    for i, r in got.iterrows():
        a, b = want[i]
        assert (r.n, r.loss) == (a, b + want[i, "end"])
    seq = out.groupby("sequence_id").agg(n=("length", "sum"), k=("length", "size"), loss=("loss_tokens", "sum"))
    assert seq.n.max() <= 512 and seq.k.max() <= 6 and seq.loss.max() <= 200
    # each limit stops some sequence that the two others would let grow
    assert ((seq.n == 512) & (seq.k < 6) & (seq.loss < 200)).any()
    assert ((seq.loss == 200) & (seq.n < 512) & (seq.k < 6)).any()
    small = packing.pack_conversations(turns.filter("length(text) < 60"), **limits).toPandas().groupby("sequence_id").agg(n=("length", "sum"), k=("length", "size"), loss=("loss_tokens", "sum"))
    assert ((small.k == 6) & (small.n < 512) & (small.loss < 200)).any()


def test_parts_with_odd_values(spark):
    kind = "id long, parts array<struct<text:string,loss:boolean>>, start int"
    df = spark.createDataFrame([(1, [("a b", False), ("c d e", True)], 1), (2, None, 1), (3, [], 1), (None, [(None, None)], 1)], kind)
    got = {r.id: (r.doc_tokens, r.loss_tokens) for r in packing.pack(df, "id", parts_col="parts").collect()}
    assert got == {1: (6, 4), 2: (1, 0), 3: (1, 0), None: (1, 0)}
    assert packing.pack_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_new_words_of_a_text_go_to_the_library_together(tok, monkeypatch):
    from skyloom.llm import tokens

    class Counting:
        calls = 0

        def encode(self, *a, **k):
            self.calls += 1
            return tok.encode(*a, **k)

    monkeypatch.setattr(tokens, "CACHED_WORDS", 150)  # caches fill and turn over between texts
    e, rng = Encoder(default_path()), random.Random(3)
    e.tok = Counting()
    texts = [" ".join("".join(rng.choice("abcdefgé1") for _ in range(rng.randrange(2, 8))) + rng.choice(["", "", ".", ",", "--", "'s"]) for _ in range(100)) for _ in range(20)]
    for s in texts + texts[::-1] + ["a\n".join(texts), "  ".join(texts)]:
        before = e.tok.calls
        assert np.frombuffer(e.encode(s), e.dtype).tolist() == tok.encode(s, add_special_tokens=False).ids
        assert e.tok.calls - before <= 2 + s.count("\n") + s.count("  ")


def test_token_files_shuffle_ids_and_not_texts(spark, tok, tmp_path, monkeypatch):
    from skyloom.llm import token_files

    plans, kept = [], token_files.written
    monkeypatch.setattr(token_files, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    rows = [(k * 37 % 101, "some words " * 40 + str(k)) for k in range(101)] + [(5, "b"), (5, "a"), (5, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    m = write_token_files(df, str(tmp_path / "t"), files=4)
    assert m.count() == 4 and max(r.n_docs for r in m.collect()) < 60
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, m).orderBy("start").collect()]
    at = 0
    for (i, s, n, c), (wi, wt) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = ids_of(tok, wt)
        assert (i, s, n, c) == (wi, at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    top, _, below = plans[0].partition("Repartition")  # the exchange lies between writing and encoding
    assert top.count("MapInArrow") == 1 and below.count("MapInArrow") == 1


def test_masks_of_whole_sequences_are_stored_once_a_batch(tmp_path):
    from skyloom.llm.token_files import BATCH, Writer

    ids = np.arange(3 * BATCH * 64 + 5 * 64 + 10, dtype="<u2")
    w = Writer(f"{tmp_path}/x", "<u2", 64, pa.int64())
    for k in range(0, len(ids), 1000):
        w.add(k, ids[k : k + 1000].tobytes())
    w.close()
    f = TokenFile(f"{tmp_path}/x")
    n = 3 * BATCH + 6
    assert (np.concatenate([f.sequence(k) for k in range(n)])[: len(ids)] == ids).all()
    assert [int(f.mask(k).sum()) for k in range(n)] == [64] * (n - 1) + [10] and f.mask(n - 1).tolist() == [1] * 10 + [0] * 54
    assert {len(f.mask(k)) for k in range(n)} == {64}
    assert f.source.size() < 2.2 * len(ids)  # two bytes an id; before, a third for its mask
    f.close()


@pytest.mark.parametrize("limits, cut", [((100, 5, 100), True), ((100, 2, 100), True), ((100, 5, 100), False)])
def test_plain_pools_fill_as_the_dot_product_does(monkeypatch, limits, cut):
    r = np.random.default_rng(3)
    docs = [np.arange(int(n)) for n in r.integers(0, 101 if not cut else 260, 900)]
    made = lambda: [[(p.example, p.start, len(p.ids)) for p in s] for s in packing.pack_stream(((k, d, None) for k, d in enumerate(docs)), limits, cut)]
    got = made()
    monkeypatch.setattr(packing, "fill", general_fill())
    monkeypatch.setattr(packing, "PlainPool", packing.Pool)
    assert got == made()


def general_fill():
    """``fill`` without its way for plain pools."""
    import inspect

    source = inspect.getsource(packing.fill).replace("isinstance(pool, PlainPool)", "False")
    space = dict(vars(packing))
    exec("from __future__ import annotations\n" + source, space)
    return space["fill"]

"""Quality of documents by a linear-chain conditional random field over their lines.

Each line gets the label good or bad. Its features are counts of kinds of characters and words
in the line and in its two neighbours; a 2 x 2 table scores neighbouring labels. The model is
fitted with numpy on a bounded sample of labelled documents, whose label each of their lines
takes. Forward-backward gives each line's probability of being good; their mean, weighted by the
lines' lengths, is the document's, and a logistic curve fitted on the same sample calibrates it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, smallest_hashes

#: Bounds of the fitted sample: documents of each label; longer ones are fitted in stretches of so many lines.
SAMPLE, STRETCH = 600, 32
THRESHOLD = 0.3
#: Kinds of characters: lower case, upper case, digit, white space, sentence marks, brackets and quotes, bars, other marks, other letters, rest.
LOWER, UPPER, DIGIT, SPACE, STOP, QUOTE, BAR, MARK, LETTER, REST = range(10)
KINDS = 10


def kinds_table() -> np.ndarray:
    """Kind of each code point below 2**16; those above count as REST."""
    t = np.full(1 << 16, REST, dtype=np.int8)
    for c in range(1 << 16):
        x = chr(c)
        if x.isspace():
            t[c] = SPACE
        elif x.isdigit():
            t[c] = DIGIT
        elif x.isalpha():
            t[c] = UPPER if x.isupper() else LOWER if c < 128 else LETTER
    for x, k in ((".,;:?!", STOP), ("()[]'\"-«»“”‘’", QUOTE), ("|", BAR), ("#$%&*+=~^<>{}/\\@_`", MARK)):
        for c in x:
            t[ord(c)] = k
    return t


TABLE = kinds_table()
OWN = 2 * KINDS + 11
WIDTH = 3 * OWN + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line of a whole text (n x WIDTH) and the lines' lengths in characters."""
    text = text or ""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = TABLE[np.minimum(code, (1 << 16) - 1)].astype(np.int64)
    ends = code == 10
    line = np.cumsum(ends) - ends
    n = int(ends.sum()) + 1
    count = np.bincount((line * KINDS + kind)[~ends], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    chars = count.sum(axis=1)
    solid = np.concatenate([[False], kind != SPACE, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    first, last = edge[::2], edge[1::2]
    size, of = last - first, line[first] if len(first) else first
    words = np.bincount(of, minlength=n).astype(np.float64)
    per = np.maximum(words, 1)
    share = count / np.maximum(chars, 1)[:, None]
    alpha = count[:, LOWER] + count[:, UPPER] + count[:, LETTER]
    marked = np.bincount(of[kind[last - 1] >= BAR], minlength=n) if len(of) else words
    stops = np.bincount(of[kind[last - 1] == STOP], minlength=n) if len(of) else words
    lines = text.split("\n")
    seen, again = set(), np.zeros(n)
    for k, x in enumerate(lines):
        again[k] = x in seen and len(x) > 0
        seen.add(x)
    distinct = np.array([len(set(x.split())) for x in lines], dtype=np.float64)
    own = np.column_stack([
        share, np.log1p(count), np.log1p(chars), np.log1p(words), chars / per / 10,
        np.bincount(of, weights=size <= 3, minlength=n) / per if len(of) else words, np.bincount(of, weights=size >= 12, minlength=n) / per if len(of) else words,
        marked / per, stops / per, count[:, UPPER] / np.maximum(alpha, 1), again, distinct / per, chars == 0,
    ])
    x = np.zeros((n, WIDTH))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[0, -3] = x[-1, -2] = 1
    x[:, -1] = 1
    return x, chars


@dataclass
class Crf:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    base: float = 0.0

    def good(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward-backward; messages are odds of good against bad."""
        u = np.clip(((x - self.mean) / self.spread) @ self.weights, -30, 30)
        e = np.exp(u).tolist()
        bb, bg, gb, gg = np.exp(self.pair).ravel().tolist()
        n = len(e)
        ahead, back = [0.0] * n, [1.0] * n
        r = 1.0
        for k in range(n):
            r = ahead[k] = e[k] * ((bg + gg * r) / (bb + gb * r) if k else 1.0)
        for k in range(n - 2, -1, -1):
            o = e[k + 1] * back[k + 1]
            back[k] = (gb + gg * o) / (bb + bg * o)
        odds = np.array(ahead) * np.array(back)
        return odds / (1 + odds)

    def mean_good(self, text: str | None) -> float:
        x, chars = line_features(text)
        w = chars + 1
        return float((self.good(x) * w).sum() / w.sum())

    def score(self, text: str | None) -> float:
        z = self.slope * logit(self.mean_good(text)) + self.base
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def adam(grad, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        g = grad(theta)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return theta


def fit(docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray, *, steps: int = 100, rate: float = 0.07, decay: float = 1e-3) -> Crf:
    """Maximum likelihood of the labels of all lines, sequences as one batch; then the weights stay and documents calibrate.

    docs: line features of each document; label: 1 good, 0 bad; weight: how many documents each
    stands for. With one label only, every score is that label's share.
    """
    if not len(docs) or len(set(label.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return Crf(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(logit(share)))
    every = np.concatenate(docs)
    mean, spread = every.mean(axis=0), every.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    parts = [(d[a : a + STRETCH], y) for d, y in zip(docs, label) for a in range(0, len(d), STRETCH)]
    t = max(len(p) for p, _ in parts)
    x = np.zeros((len(parts), t, WIDTH), dtype=np.float32)
    there = np.zeros((len(parts), t), dtype=bool)
    for k, (p, _) in enumerate(parts):
        x[k, : len(p)] = (p - mean) / spread
        there[k, : len(p)] = True
    y = np.array([v for _, v in parts], dtype=np.int64)
    flat = x[there]
    per_class = np.array([1 / max(1, ((y == v)[:, None] & there).sum()) for v in (0, 1)])
    mass = (np.broadcast_to(per_class[y][:, None], there.shape) * 0.5).astype(np.float64)

    def grad(theta):
        w, pair = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        u = np.zeros(there.shape)
        u[there] = np.clip(flat @ w, -30, 30)
        e = np.stack([np.zeros_like(u), u], axis=2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for k in range(1, t):
            nxt = np.logaddexp(fwd[:, k - 1, 0, None] + pair[0], fwd[:, k - 1, 1, None] + pair[1]) + e[:, k]
            fwd[:, k] = np.where(there[:, k, None], nxt, fwd[:, k - 1])
        for k in range(t - 2, -1, -1):
            m = e[:, k + 1] + bwd[:, k + 1]
            prv = np.logaddexp(pair[:, 0] + m[:, 0, None], pair[:, 1] + m[:, 1, None])
            bwd[:, k] = np.where(there[:, k + 1, None], prv, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None])
        g = np.where(there, (p - y[:, None]) * mass, 0)
        gw = flat.T @ g[there] + decay * w / len(w)
        both = there[:, 1:] & there[:, :-1]
        gp = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                q = np.exp(fwd[:, :-1, a] + pair[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z[:, None])
                gp[a, b] = (((q - ((y == a) & (y == b))[:, None]) * mass[:, 1:])[both]).sum()
        return np.concatenate([gw, (gp + decay * pair).ravel()])

    theta = adam(grad, np.zeros(WIDTH + 4), steps, rate)
    return Crf(mean, spread, theta[:WIDTH], np.clip(theta[WIDTH:].reshape(2, 2), -3, 3))


def calibrate(crf: Crf, means: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Crf:
    """A logistic curve from the logit of the mean to the label, each document with its weight."""
    if crf.slope == 0.0:
        return crf
    x = logit(means)

    def grad(theta):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -40, 40)))
        g = (p - label) * weight / weight.sum()
        return np.array([(g * x).sum() + 1e-4 * theta[0], g.sum()])

    crf.slope, crf.base = (float(v) for v in adam(grad, np.array([1.0, 0.0]), 1500, 0.02))
    crf.slope = max(crf.slope, 1e-3)
    return crf


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, sample: int) -> Crf:
    """Fits on at most ``sample`` labelled documents of each label in the training folds; the last quarter of the hashes calibrates."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (remainder(F.col(id_col), folds) != held))
    sizes = {r["y"]: r["count"] for r in known.groupBy(F.col(label_col).alias("y")).count().collect()}
    picked = None
    for y in (0, 1):
        some = smallest_hashes(known.filter(F.col(label_col) == y).select(F.col(id_col).alias("id")).distinct(), sample).withColumn("y", F.lit(y))
        picked = some if picked is None else picked.unionAll(some)
    # at most 2 * sample rows: safe to broadcast
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for y, t in zip(batch.column(0), batch.column(1)):
                x, chars = line_features(t.as_py())
                yield pa.RecordBatch.from_pydict({"y": pa.array([y.as_py()], pa.int32()), "x": [x.astype(np.float32).tobytes()], "c": [chars.tobytes()]})

    rows = chosen.select("y", "text").mapInArrow(features, "y int, x binary, c binary").collect()
    label = np.array([r["y"] for r in rows], dtype=np.int64)
    xs = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    weight = np.array([sizes[y] / max(1, (label == y).sum()) for y in label], dtype=np.float64)
    crf = fit(xs, label, weight)
    means = []
    for x, r in zip(xs, rows):
        w = np.frombuffer(r["c"], dtype=np.float64) + 1
        means.append((crf.good(x) * w).sum() / w.sum())
    return calibrate(crf, np.array(means), label, weight)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *,
    folds: int = 5, held: int = 0, threshold: float = THRESHOLD, sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` with held_out (boolean), score (double, 0 to 1) and predicted (int, score >= threshold).

    Only labels of rows outside the held-out fold (crc32 of the id as text, modulo ``folds``)
    are learned from, and the text alone makes the score. Whole texts are scored. A null or empty
    text is one empty line. Rows with null ids are scored and not held out; repeated rows get the
    same score. Columns called held_out, score or predicted are replaced. With labels of one kind
    only, every score is that kind's smoothed share. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, folds, held, sample))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    out = docs.drop("held_out", "score", "predicted")
    out = out.withColumn("held_out", remainder(F.col(id_col), folds) == held).withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words is fitted with numpy from confirmed toxic texts
and unlabelled texts. With the class prior p, the risk of calling unlabelled text clean is
corrected by p times the risk of calling toxic text clean; that corrected term estimates the
risk on clean text, and where it turns negative (overfitting) the step goes the other way.
"""

from __future__ import annotations

import math
import string
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, smallest_hashes
from .shared import written

#: Bounds of the fitted sample, confirmed toxic texts and unlabelled texts, and words of the model.
POSITIVES, UNLABELLED, WORDS = 4000, 8000, 4096
THRESHOLD = 0.7
#: Standard errors by which a word's rates must differ; chance passes it for few of a million words.
SURE = 4.0
#: Lengths of the beginnings of words that count as features besides the words.
STEMS = (4, 5, 6)
STRIP = string.punctuation + "“”‘’«»¿¡…–—"


def word_keys(text: str | None) -> set[int]:
    """Hashes of the distinct lower-cased words of a whole text, without punctuation at their ends, and of the words' first letters."""
    found = {x.strip(STRIP) for x in set((text or "").lower().split())}
    found.discard("")
    stems = {w[:n] + "*" for n in STEMS for w in found}
    return set(map(zlib.crc32, map(str.encode, found | stems)))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    threshold: float
    scale: float

    def raw(self, text: str | None) -> float:
        get = self.weights.get
        return self.bias + sum(v for v in map(get, word_keys(text)) if v)

    def score(self, text: str | None) -> float:
        """0 to 1; the fitted cut lies at THRESHOLD."""
        z = self.scale * (self.raw(text) - self.threshold) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def choose_words(docs: DataFrame, toxic: DataFrame, words: int) -> np.ndarray:
    """The words whose rates in confirmed toxic texts and in all texts differ most surely: at least SURE standard errors apart.

    docs: (id, text), all of them; toxic: the ids of the confirmed ones. Texts are counted on the
    executors, batch by batch before the shuffle, and only the ``words`` best keys come back.
    """
    marked = docs.join(toxic.withColumn("p", F.lit(True)), "id", "left").select("text", F.coalesce("p", F.lit(False)).alias("p"))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.fromiter(word_keys(t.as_py()), dtype=np.int64) for t in batch.column(0)]
            p = batch.column(1).to_numpy(zero_copy_only=False)
            keys, at = np.unique(np.concatenate([*found, [-1]]).astype(np.int64), return_inverse=True)
            u = np.bincount(at, minlength=len(keys))
            mine = np.concatenate([*(x for x, y in zip(found, p) if y), np.zeros(0)]).astype(np.int64)
            n = np.bincount(np.searchsorted(keys, mine), minlength=len(keys))
            u[0], n[0] = len(found), p.sum()  # the key -1 counts the texts
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["k", "u", "p"])

    counts = written(marked.mapInArrow(count, "k long, u long, p long").groupBy("k").agg(F.sum("u").alias("u"), F.sum("p").alias("p")), "word-counts")
    texts = counts.filter("k = -1").first()
    if texts is None or not texts["p"] or not texts["u"]:
        return np.zeros(0, dtype=np.uint32)
    n_u, n_p = float(texts["u"]), float(texts["p"])
    rate = (F.col("u") + F.col("p")) / (n_u + n_p)
    error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / n_u + 1 / n_p))
    sure = F.abs(F.col("p") / n_p - F.col("u") / n_u) / error
    best = counts.filter("k >= 0").withColumn("sure", sure).filter(F.col("sure") >= SURE).orderBy(F.desc("sure"), "k").limit(words)
    return np.sort(np.array([r["k"] for r in best.select("k").collect()], dtype=np.uint32))


def corrected_risk(f: np.ndarray, p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The risk of scores f that is descended, and its gradient; p marks confirmed toxic texts, the others are unlabelled.

    prior * mean loss of toxic as clean comes off the unlabelled texts' loss as clean; where that
    corrected risk of clean text is negative (overfitting), its opposite is descended instead.
    """
    u = ~p
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    up, clean = 1 / (1 + np.exp(-np.clip(f, -40, 40))), np.logaddexp(0, f)
    rest = clean[u].sum() / n_u - prior * clean[p].sum() / n_p
    g = np.zeros(len(f))
    if rest >= 0:
        g[u] = up[u] / n_u
        g[p] = -prior * up[p] / n_p + prior * (up[p] - 1) / n_p
        return prior * np.logaddexp(0, -f[p]).sum() / n_p + rest, g
    g[u] = -up[u] / n_u
    g[p] = prior * up[p] / n_p
    return -rest, g


def fit(docs: list[np.ndarray], positive: np.ndarray, prior: float, keys: np.ndarray, *, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fits the classifier. docs: word keys of each text; positive: which are confirmed toxic; the rest are unlabelled; keys: the model's words, sorted.

    Without a confirmed toxic text, or without words to tell, every score is just below the cut.
    """
    if not positive.any() or not len(keys):
        return Model({}, 0.0, 1.0, 4.0)
    prior = min(max(prior, 1e-3), 0.9)
    rows, cols = [], []
    for k, d in enumerate(docs):
        got = np.intersect1d(keys, d, assume_unique=True, return_indices=True)[1]
        rows.append(np.full(len(got), k))
        cols.append(got)
    row, col = np.concatenate(rows), np.concatenate(cols)
    n, v = len(docs), len(keys)
    w, b = np.zeros(v), math.log(prior / (1 - prior))
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    p, u = positive, ~positive
    n_p, n_u = p.sum(), max(1, u.sum())
    for step in range(1, steps + 1):
        f = b + np.bincount(row, weights=w[col], minlength=n)
        _, g = corrected_risk(f, p, prior)
        grad = np.append(np.bincount(col, weights=g[row], minlength=v) + decay * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:v], b - move[v]
    f = b + np.bincount(row, weights=w[col], minlength=n)
    # the cut lies midway between zero, where the corrected risk has its own, and the cut with the most
    # recall squared over the share called toxic, which positive and unlabelled texts allow to estimate
    order = np.unique(f)
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    f_p, f_u = np.sort(f[p]), np.sort(f[u])
    recall = 1 - np.searchsorted(f_p, cuts) / n_p
    called = 1 - np.searchsorted(f_u, cuts) / n_u
    value = recall**2 / np.maximum(called, prior / 4)
    gap = np.diff(order) if len(order) > 1 else np.ones(1)
    near = value >= 0.98 * value.max()
    cut = cuts[np.argmax(np.where(near, gap, -1))] / 2
    spread = max(1e-3, float(np.median(f_p) - cut))
    return Model(dict(zip(keys.tolist(), w.tolist())), float(b), float(cut), 2.0 / spread)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, positives: int, unlabelled: int) -> Model:
    """Fits on labels of the training folds. All texts of these folds choose the words; at most ``positives`` toxic texts and ``unlabelled`` texts, their labels unseen, fit the weights and the cut."""
    known = labels.filter(F.col(id_col).isNotNull() & (remainder(F.col(id_col), folds) != held))
    share = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    confirmed = written(known.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct(), "toxic-ids")
    rows = docs.filter(F.col(id_col).isNotNull() & (remainder(F.col(id_col), folds) != held)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = choose_words(rows, confirmed, WORDS)
    toxic = smallest_hashes(confirmed, positives)
    some = smallest_hashes(rows.select("id").distinct(), unlabelled)
    sample = toxic.select("id", F.lit(True).alias("p")).unionAll(some.select("id", F.lit(False).alias("p")))
    # at most positives + unlabelled rows: safe to broadcast
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for p, t in zip(batch.column(0), batch.column(1)):
                key = np.intersect1d(np.fromiter(word_keys(t.as_py()), dtype=np.uint32), words, assume_unique=True)
                yield pa.RecordBatch.from_pydict({"p": [p.as_py()], "k": [key.tobytes()]})

    got = chosen.select("p", "text").mapInArrow(features, "p boolean, k binary").toPandas()
    return fit([np.frombuffer(k, dtype=np.uint32) for k in got["k"]], got["p"].to_numpy(dtype=bool), share or 0.0, words)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
    folds: int = 3, held: int = 1, threshold: float = THRESHOLD, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> DataFrame:
    """``docs`` with held_out (boolean), score (double, 0 to 1) and predicted (int, score >= threshold).

    Only labels of rows outside the held-out fold (crc32 of the id as text, modulo ``folds``)
    are learned from, and the text alone makes the score. Whole texts are scored. Null and empty
    texts get the score of a text without known words. Rows with null ids are scored and not
    held out; repeated rows each get the same score. Columns called held_out, score or predicted
    are replaced. Without toxic labels nothing is called toxic. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, folds, held, positives, unlabelled)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    out = docs.drop("held_out", "score", "predicted")
    out = out.withColumn("held_out", remainder(F.col(id_col), folds) == held).withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

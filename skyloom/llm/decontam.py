"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are pairs of an item's words that stand one or two apart. An alignment of score S or more
with m matches has at most 2 m - S edits, and two edits must fall between two matches to keep them
from being such a pair on both sides; so at least ``ceil(S / 2) - 1`` seeds begin at different words
of the item and of the document, within the stretch that the alignment can span. Up to half of
those may be left out: the pairs that many items hold. One pass finds the rest in each whole
document and aligns only the stretches that hold as many as are due, so no alignment that scores
enough is missed, whatever its edits. Its score over that of the item with itself measures how
much of the item the stretch holds.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE = 0.5
#: Items from which a pair counts as common.
COMMON = 50
#: Items that one pass over the documents serves; a bound on what is sent to the executors.
ITEM_BLOCK = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"\w+")


class Hashes(dict):
    """word -> hash, for up to 100,000 words at a time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


WORDS = Hashes()


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of the whole text."""
    return np.fromiter(map(WORDS.__getitem__, WORD.findall((text or "").lower())), dtype=np.uint64)


def pairs(w: np.ndarray, gap: int) -> np.ndarray:
    """A hash of each word with the one ``gap`` places on; 0: of the word alone."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    a, b = (w, np.uint64(0)) if gap == 0 else (w[:-gap], w[gap:])
    g = ((a * mix) ^ b) * mix
    return g ^ (g >> np.uint64(29))


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, end in the item, end in the part (ends exclusive)."""
    ramp = np.arange(len(part) + 1) * -GAP
    last = np.zeros(len(part) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, x in enumerate(item):
        t = np.zeros_like(last)
        t[1:] = np.maximum(last[:-1] + np.where(part == x, MATCH, MISMATCH), 0)
        t = np.maximum(t, last + GAP)
        last = np.maximum.accumulate(t + ramp) - ramp
        j = int(last.argmax())
        if last[j] > best[0]:
            best = (int(last[j]), i + 1, j)
    return best


class Seeds:
    """The seeds of a block of items, with a bit table that turns most other pairs away.

    need: the seeds that an alignment of ``least`` of the item's score must begin at different
    words; reach: the words of a document that it can span. Items too short for a seed are sought
    as a whole: one word, or two in a row.
    """

    def __init__(self, items: list[tuple[object, np.ndarray]], least: float):
        self.items, self.least = items, least
        size = np.array([len(w) for _, w in items], dtype=np.int64)
        score = np.ceil(MATCH * least * size - 1e-9).astype(np.int64)
        self.need = np.maximum(1, -(-score // 2) - 1)
        self.reach = 3 * size - score
        self.gaps = [1, 2] + [0] * bool((size == 1).any())
        key, item, start = [], [], []
        for k, (_, w) in enumerate(items):
            for gap in (1, 2) if len(w) > 2 else (len(w) - 1,):
                g = pairs(w, gap)
                key.append(g)
                item.append(np.full(len(g), k, dtype=np.int64))
                start.append(np.arange(len(g)))
        key, item, start = (np.concatenate(x) for x in (key, item, start))
        held = np.unique(np.stack([key, item.astype(np.uint64)]), axis=1)[0]
        known, holders = np.unique(held, return_counts=True)
        holders = holders[np.searchsorted(known, key)]
        keep = np.ones(len(key), dtype=bool)
        at = np.flatnonzero(holders > COMMON)
        begins = {}
        for k, q, n in zip(item[at].tolist(), start[at].tolist(), holders[at].tolist()):
            begins.setdefault(k, {})[q] = max(n, begins.get(k, {}).get(q, 0))
        for k, common in begins.items():
            out = sorted(common, key=lambda q: -common[q])[: int(self.need[k]) // 2]
            keep &= ~((item == k) & np.isin(start, out))
            self.need[k] -= len(out)
        key, item = key[keep], item[keep]
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.item, self.first = item[order], np.append(first, len(key))
        bits = min(26, max(20, (16 * len(self.keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, dtype=bool)
        self.bits[self.keys >> self.shift] = True

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position) of the seeds in the words, each once, in this order."""
        keys, places = [], []
        for gap in self.gaps:
            g = pairs(w, gap)
            at = np.flatnonzero(self.bits[g >> self.shift])
            k = np.searchsorted(self.keys, g[at])
            k[k == len(self.keys)] = 0
            ok = self.keys[k] == g[at] if len(self.keys) else np.zeros(len(at), dtype=bool)
            keys.append(k[ok])
            places.append(at[ok])
        k, at = np.concatenate(keys), np.concatenate(places)
        n = self.first[k + 1] - self.first[k] if len(k) else np.zeros(0, dtype=np.int64)
        each = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(k) else n
        both = np.unique(self.item[each] * (len(w) + 1) + np.repeat(at, n))
        return both // (len(w) + 1), both % (len(w) + 1)


def find(seeds: Seeds, w: np.ndarray):
    """(item, score, doc start, doc end, item start, item end, seeds) for each item the words hold; word positions."""
    item, at = seeds.hits(w)
    last = np.arange(len(item)) + seeds.need[item] - 1
    ok = np.flatnonzero(last < len(item))
    ok = ok[(item[last[ok]] == item[ok]) & (at[last[ok]] - at[ok] <= seeds.reach[item[ok]])]
    for k in np.unique(item[ok]).tolist():
        ids, x = seeds.items[k]
        reach, mine, best = int(seeds.reach[k]), ok[item[ok] == k], None
        lo, hi, part_of = np.maximum(0, at[mine] - reach), np.minimum(len(w), at[last[mine]] + reach + 3), []
        for a, b in zip(lo.tolist(), hi.tolist()):
            if part_of and a <= part_of[-1][1]:
                part_of[-1][1] = max(b, part_of[-1][1])
            else:
                part_of.append([a, b])
        for a, b in part_of:
            part = w[a:b]
            if np.isin(x, part).mean() < seeds.least:
                continue
            s, i, j = align(x, part)
            if s >= seeds.least * MATCH * len(x) - 1e-9 and (best is None or s > best[0]):
                _, i0, j0 = align(x[:i][::-1], part[:j][::-1])
                n = int(((item == k) & (at >= a) & (at < b)).sum())
                best = (s, a + j - j0, a + j, i - i0, i, n)
        if best is not None:
            s, *rest = best
            yield (ids, s / (MATCH * len(x)), *rest)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    score: float = SCORE, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """One row for each document and test item that it holds: ids, score (to 1), spans in words and seeds.

    doc_start, doc_end, item_start and item_end are word positions, ends exclusive. A document is
    listed where the best alignment of the item within it scores ``score`` of the item's own or
    more; the seeds miss none of these. Words are runs of letters, digits and underscores,
    lower-cased. Items of one or two words are sought whole; items and texts without words (null,
    empty) match nothing.
    Items go in blocks of ``item_block``, each sent to all tasks and met by all documents. Rows
    with null ids are left out; repeated rows are listed each. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, item_col)))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tests = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    blocks = -(-tests.count() // item_block) or 1
    schema = f"id {kind}, item {item_kind}, score double, doc_start long, doc_end long, item_start long, item_end long, seeds long"
    out = None
    for b in range(blocks):
        got = tests.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        items = [(r["id"], w) for r in got if len(w := words(r["text"]))]
        if not items:
            continue
        sent = spark.sparkContext.broadcast(Seeds(items, score))

        def match(batches, sent=sent):
            import pyarrow as pa

            types = None
            for batch in batches:
                found = []
                for i, t in zip(batch.column(0), batch.column(1)):
                    found += [(i.as_py(), *x) for x in find(sent.value, words(t.as_py()))]
                types = [batch.column(0).type, None, pa.float64()] + [pa.int64()] * 5
                cols = list(zip(*found))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, types)], ["id", "item", "score", "doc_start", "doc_end", "item_start", "item_end", "seeds"])

        hits = rows.mapInArrow(match, schema)
        out = hits if out is None else out.unionAll(hits)
    if out is None:
        out = spark.createDataFrame([], schema)
    name = item_col if item_col != id_col else f"item_{item_col}"
    return out.withColumnsRenamed({"id": id_col, "item": name})

"""Document fingerprints from prefix polynomial hashes.

A text's code points are the coefficients of polynomials at four fixed bases modulo 2^31 - 1; the
values of all its prefixes are kept as arrays. The value of a span is a difference of two of them,
so any two spans are told equal in constant time, two texts joined get their arrays without a second
look at their code points, and the longest common extension of two places is found by binary search.

A fingerprint is the length and the four values of the whole text. Two texts are compared by the
share of their code points in common spans: the longest common prefix and suffix, and the
extensions, both ways, of equal windows chosen by their own hash.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .shared import arrow_rows, free_name, written

#: The modulus, a Mersenne prime, and the bases, drawn once at random. Fingerprints depend on them.
MOD = (1 << 31) - 1
BASES = (1_190_494_759, 742_938_285, 1_654_047_613, 1_982_356_031)
#: Bases that tell spans apart; all four are used for fingerprints.
SPAN = 2
#: Code points of a window, and the share of windows that are looked up (one in so many, by their hash).
WINDOW, CHOSEN = 32, 16

_powers = np.ones((len(BASES), 1), dtype=np.uint64)
_inverse = np.ones((SPAN, 1), dtype=np.uint64)


def grown(table: np.ndarray, bases, n: int) -> np.ndarray:
    """Powers 0 to at least ``n`` of each base, by doubling."""
    while table.shape[1] <= n:
        step = np.array([[pow(b, table.shape[1], MOD)] for b in bases], dtype=np.uint64)
        table = np.concatenate([table, table * step % MOD], axis=1)
    return table


def powers(n: int) -> np.ndarray:
    global _powers
    _powers = grown(_powers, BASES, n)
    return _powers


def inverse(n: int) -> np.ndarray:
    global _inverse
    _inverse = grown(_inverse, [pow(b, -1, MOD) for b in BASES[:SPAN]], n)
    return _inverse


class Hashed:
    """A text's prefix values, as an array of shape (bases, length + 1)."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, values.shape[1] - 1

    @classmethod
    def of(cls, text: str) -> Hashed:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        values = np.zeros((len(BASES), len(codes) + 1), dtype=np.uint64)
        # terms stay below 2^31, so sums of up to 2^32 of them fit
        np.cumsum((codes + 1) * powers(len(codes))[:, : len(codes)] % MOD, axis=1, out=values[:, 1:])
        values %= MOD
        return cls(values)

    def joined(self, keep: int, other: Hashed, take: int) -> Hashed:
        """The first ``keep`` code points, and the first ``take`` of another text."""
        shifted = (self.values[:, keep, None] + other.values[:, 1 : take + 1] * powers(keep)[:, keep, None]) % MOD
        both = Hashed(np.concatenate([self.values[:, : keep + 1], shifted], axis=1))
        # windows inside either part are known; only those across the seam are new
        own, theirs = self.windows, other.windows
        a, b = own[1] + WINDOW <= keep, theirs[1] + WINDOW <= take
        seam = both.chosen(max(0, keep - WINDOW + 1), min(keep, keep + take - WINDOW + 1))
        both.windows = tuple(np.concatenate(x) for x in zip((own[0][a], own[1][a]), seam, (theirs[0][b], theirs[1][b] + keep)))
        return both

    def fingerprint(self) -> str:
        return f"{self.n:x}:" + "".join(f"{int(x):08x}" for x in self.values[:, -1])

    def equal(self, at: int, other: Hashed, there: int, n: int) -> bool:
        """Whether ``n`` code points from ``at`` are those of ``other`` from ``there``, up to collisions of 62 bits."""
        table = powers(max(at, there))
        for k in range(SPAN):
            a, b = self.values[k], other.values[k]
            x, y = int(a[at + n]) - int(a[at]), int(b[there + n]) - int(b[there])
            if x * int(table[k, there]) % MOD != y * int(table[k, at]) % MOD:
                return False
        return True

    def forward(self, at: int, other: Hashed, there: int) -> int:
        """Length of the longest common extension to the right."""
        return longest(min(self.n - at, other.n - there), lambda n: self.equal(at, other, there, n))

    def backward(self, at: int, other: Hashed, there: int) -> int:
        """Length of the longest common extension to the left."""
        return longest(min(at, there), lambda n: self.equal(at - n, other, there - n, n))

    def chosen(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, place) of the windows that begin in [start, stop) and are chosen by their hash."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        v = self.values[:SPAN]
        x = (v[:, start + WINDOW : stop + WINDOW] + MOD - v[:, start:stop]) % MOD * inverse(stop)[:, start:stop] % MOD
        place = np.flatnonzero(x[0] % CHOSEN == 0)
        return (x[0, place] << np.uint64(31)) | x[1, place], place + start

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return self.chosen(0, self.n - WINDOW + 1)


def longest(most: int, holds) -> int:
    """The largest n up to ``most`` for which ``holds(n)``, true up to some n and false beyond: doubling, then binary search."""
    low, high = 0, 1
    while high <= most and holds(high):
        low, high = high, 2 * high
    high = min(high, most + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low


def common_spans(a: Hashed, b: Hashed) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of common spans: prefix, suffix, and those around equal chosen windows of a and of b."""
    spans = [(0, 0, a.forward(0, b, 0))]
    n = a.backward(a.n, b, b.n)
    spans.append((a.n - n, b.n - n, n))
    if spans[0][2] == a.n == b.n:
        return spans[:1]
    keys, i, j = np.intersect1d(*(w[0] for w in (a.windows, b.windows)), return_indices=True)
    if len(keys):
        shared = [w[1][np.isin(w[0], keys)] for w in (a.windows, b.windows)]
        where = [dict(zip(keys.tolist(), w[1][k].tolist())) for w, k in ((b.windows, j), (a.windows, i))]
        for side, (mine, text) in enumerate(zip(shared, (a, b))):
            held = dict(zip(text.windows[1].tolist(), text.windows[0].tolist()))
            done = max((s[side] + s[2] for s in spans[:1]), default=0)
            ends = spans[1][side]
            covered = sorted((s[side], s[side] + s[2]) for s in spans if s[2])
            at = 0
            while at < len(mine):
                p = int(mine[at])
                if p + WINDOW <= done or p >= ends or (side and any(x <= p and p + WINDOW <= y for x, y in covered)):
                    at += 1
                    continue
                q = where[side][held[p]]
                x, y = (p, q) if side == 0 else (q, p)
                left, right = a.backward(x, b, y), a.forward(x, b, y)
                spans.append((x - left, y - left, left + right))
                done = max(done, p + right)
                at = int(np.searchsorted(mine, done - WINDOW, side="right"))
    return [s for s in spans if s[2]]


def covered(spans: list[tuple[int, int, int]], side: int) -> int:
    """Places of one text that lie in a span."""
    total = end = 0
    for start, n in sorted((s[side], s[2]) for s in spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


def likeness(a: Hashed, b: Hashed) -> float:
    """The share of both texts' code points in common spans: 1 for equal texts, two empty ones too."""
    if not a.n + b.n:
        return 1.0
    spans = common_spans(a, b)
    return (covered(spans, 0) + covered(spans, 1)) / (a.n + b.n)


def edited(text: str, following: str) -> tuple[str, int, int]:
    """A text whose last third is replaced by as much of the start of another; what is kept of one and taken of the other."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n], len(text) - n, min(n, len(following))


def judged(text: str, own: Hashed, following: str, other: Hashed) -> dict:
    new, keep, take = edited(text, following)
    theirs = own.joined(keep, other, take)
    return {
        "n_chars": len(text), "edited_text": new, "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own.fingerprint(),
        "edited_fingerprint": theirs.fingerprint(), "near_edited": likeness(own, theirs), "near_next": likeness(own, other),
    }


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(df: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``df`` with the fingerprints of two text columns (null: empty), their likeness, and their common spans (left_at, right_at, length).

    New columns: left_fingerprint, right_fingerprint, likeness, spans; columns of these names are replaced.
    """
    names = ("left_fingerprint", "right_fingerprint", "likeness", "spans")
    df = df.drop(*names)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = [(Hashed.of(x or ""), Hashed.of(y or "")) for x, y in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist())]
            columns = [[x.fingerprint() for x, _ in pairs], [y.fingerprint() for _, y in pairs], [likeness(x, y) for x, y in pairs]]
            spans = [[dict(zip(("left_at", "right_at", "length"), s)) for s in sorted(set(common_spans(x, y)))] for x, y in pairs]
            kinds = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("left_at", "right_at", "length")]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=t) for c, t in zip([*columns, spans], kinds))], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, left_fingerprint string, right_fingerprint string, likeness double, spans array<struct<left_at: bigint, right_at: bigint, length: bigint>>")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, texts: bool = True, batch_rows: int = 256) -> DataFrame:
    """One row a document, with the fingerprint of its text and of its edited text, and how near they and the next document are.

    (<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), and
    edited_text where ``texts`` is set. The next document is that of the next smaller id (after the
    smallest: the first); rows of one id follow each other by the hash of their texts, then by the
    texts; null ids come last. A null text is an empty one. A table of one row is its own next.
    Other columns are not read. An empty table gives an empty result.

    The texts are shuffled once, to ranges of ids; inside a range the next document is the next row,
    and only the first and the last row of each range meet in a second, small step.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("id"), F.col("tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text", F.spark_partition_id().alias("part"))
    shown = RESULT + (", edited_text string" if texts else "")
    names = [f.split()[0] for f in shown.split(", ")]
    fields = f"id {kind}, {shown}, part int, edge string, text string"

    schema = to_arrow_schema(StructType.fromDDL(fields))

    def batch_of(rows: list[dict]):
        import pyarrow as pa

        return pa.RecordBatch.from_pylist(rows, schema)

    def walk(batches):
        before = None
        for batch in batches:
            out = []
            for i, text, part in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part"))):
                now = Hashed.of(text)
                if before is None:
                    out.append({"id": i, "part": part, "edge": "first", "text": text})
                else:
                    out.append({"id": before[0], **judged(before[1], before[2], text, now)})
                before = i, text, now, part
            yield batch_of(out)
        if before:
            yield batch_of([{"id": before[0], "part": before[3], "edge": "last", "text": before[1]}])

    def meet(batches):
        for batch in batches:
            triples = zip(*(batch.column(c).to_pylist() for c in ("id", "text", "following")))
            yield batch_of([{"id": i, **judged(a, Hashed.of(a), b, Hashed.of(b))} for i, a, b in triples])

    with arrow_rows(docs.sparkSession, batch_rows):
        out = written(ranged.mapInArrow(walk, fields), "fingerprints")
    first, last = (out.filter(F.col("edge") == e) for e in ("first", "last"))
    # one number for each range that has rows
    around = first.select("part").withColumn("to", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    edges = last.select("id", "text", "part").join(around, "part").join(first.select(F.col("part").alias("to"), F.col("text").alias("following")), "to")
    met = edges.select("id", "text", "following").mapInArrow(meet, fields)
    done = out.filter("edge is null").select("id", *names).unionByName(met.select("id", *names))
    return done.withColumnRenamed("id", id_col)

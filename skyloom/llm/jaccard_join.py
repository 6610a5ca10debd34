"""Exact Jaccard join of documents' word shingles, and the components of its links.

Tiles. Documents with equal sets are one class. All shingles have one fixed order: those that
many classes hold (hot ones) last, else by hash. If a smaller set and a larger one link, their
first common shingle is among the first ``n - ceil(2 t n / (1 + t)) + 1`` shingles of the smaller
(its left prefix) and among the first ``n - ceil(t n) + 1`` of the larger. A tile holds the
classes of one size band that have one such shingle; bands are as wide as the sizes of similar
sets can differ, so a tile's left rows meet the tile and the next band's. Documents that share a
template and are not similar have enough shingles of their own to fill the left prefix, so the
template's shingles are in no left prefix and make no tile.

Bounds. A class carries a bitmap of its hashed shingles. Each bit of A that B lacks is a shingle
of A that B lacks, so bit counts bound the overlap from above; so do the places of a common
shingle. Pairs that pass are decided by the intersection of the sorted arrays, computed from the
texts of just the documents concerned.

Groups. First each member of a tile meets the tile's smallest left row only, so a group of
near-copies costs its size and not its square. Then only members that are not yet in one component
meet: by a join in tiles of up to HOT rows, and block by block in larger ones, where bitmaps choose
the rows whose sets are sent. A block yields links only as long as they join components. Joins on
a hot shingle are salted, as its rows may be a large part of all.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, free_name, written

#: Rows from which a shingle or tile counts as hot; shingles stored beyond the first ones; rows of a block; parts of a hot shingle.
HOT, SLACK, BLOCK, SALTS = 128, 16, 1024, 16
#: Classes that each hot shingle names as examples of its template; examples that make a shingle hot.
EXAMPLES, AGREE = 2, 3
#: Hot shingles that are sent to the executors at most (4 MB); beyond that they are joined.
HOT_SENT = 500_000
#: Shingles that a task holds to add them up.
HELD = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """word -> 64-bit hash, for up to 100,000 words at a time."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Hashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a whole text.

    Words are runs of other than ASCII white space, A-Z lower-cased. Fewer words than ``size``
    are one shingle; no words, none.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    m = min(size, len(h))
    g = np.full(len(h) - m + 1, m, dtype=np.uint64)
    for k in range(m):
        g = (g ^ h[k : k + len(g)]) * MIX
        g ^= g >> np.uint64(31)
    return np.unique(g.view(np.int64))


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def bitmap(g: np.ndarray) -> np.ndarray:
    """A bit for the low bits of each hash; the number of bits is a power of two of about twice the set's size."""
    bits = 1 << min(16, max(8, (2 * len(g) - 1).bit_length()))
    out = np.zeros(bits, dtype=bool)
    out[g & (bits - 1)] = True
    return np.packbits(out, bitorder="little")


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """A longer bitmap as one of ``size`` bytes."""
    while len(b) > size:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def may_link(na: int, a: np.ndarray, nb: int, b: np.ndarray, num: int, den: int) -> bool:
    """False where the bit counts rule similarity num / den out."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    both = min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))
    return both * (num + den) >= num * (na + nb)


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= num * (len(a) + len(b) - both)


def sign(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(id, n, k1, k2, pre, more, bits) of (id, text): set size, digest of the set, first shingles, whether there are more, bitmap."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = [[] for _ in range(6)]
                for t in part.column(1):
                    g = shingles(t.as_py(), size)
                    k1, k2 = np.frombuffer(hashlib.blake2b(g.tobytes(), digest_size=16).digest(), dtype=np.int64).tolist()
                    head = min(len(g), prefix(len(g), num, den) + SLACK) if len(g) else 0
                    for c, v in zip(cols, (len(g), k1, k2, g[:head], head < len(g), bitmap(g).tobytes())):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, type=k) for c, k in zip(cols, kinds))], ["id", "n", "k1", "k2", "pre", "more", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, pre array<bigint>, more boolean, bits binary")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, g) with the packed sorted shingles of the documents in ``ids``, from their whole texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())], ["id", "g"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, f"id {kind}, g binary").distinct()


def first_shingles(docs: DataFrame, reps: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(s, pos, h, id, n): the first shingles of each class in the order with hot ones last, their places, and whether they are hot.

    Hot are shingles among the stored ones of more than HOT classes. Where these leave a class too
    few, the next ones of its template would take their place. So each hot shingle names EXAMPLES
    of those classes, and all shingles that AGREE examples hold are hot as well. What is hot moves
    the order only, and with it the cost: any fixed order gives the same links.
    """
    p = F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den)) - F.lit(1e-9)).cast("long") + 1
    reps = reps.select("id", "n", "pre", "more", p.cast("int").alias("p"))
    hot = written(reps.select(F.explode("pre").alias("s")).groupBy("s").count().filter(F.col("count") > HOT).select("s"), "hot-shingles")

    def ordered(hot: DataFrame) -> DataFrame:
        r = told_apart(reps, hot) if hot.count() <= HOT_SENT else told_apart_by_join(reps, hot)
        return r.withColumn("short", F.col("more") & (F.size("cold") < F.col("p")))

    short = ordered(hot).filter("short").select("id", F.explode("hot").alias("s"))
    picks = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), F.col("id"))).alias(f"x{k}") for k in range(EXAMPLES)]
    named = short.groupBy("s").agg(*picks).select(F.explode(F.array(*(F.col(f"x{k}.id") for k in range(EXAMPLES)))).alias("id"))
    most = shingle_counts(docs, written(named.distinct(), "examples"), size).groupBy("s").agg(F.sum("k").alias("k")).filter(F.col("k") >= AGREE).select("s")
    hot = written(hot.unionAll(most).distinct(), "hot-shingles")
    r = ordered(hot)
    first = F.when(~F.col("short"), F.slice(F.concat("cold", "hot"), 1, F.col("p")))
    r = written(r.select("id", "n", "p", "short", F.size("cold").alias("c"), first.alias("first")), "first-shingles")
    known = r.filter(~F.col("short")).select("id", "n", "c", "first")
    # classes with more hot shingles among the stored ones than there is slack: all of their shingles are put in order
    deep = r.filter("short").select("id", "n", "p")
    if hot.count() <= HOT_SENT:
        own = ordered_first(docs, deep, hot, size, num, den)
    else:
        marked = with_hot(every_shingle(docs, deep.select("id"), size), hot, "left").select("id", "s", F.col("hit").isNotNull().alias("h"))
        own = marked.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("h", "s"))).alias("o")).join(deep, "id")
        own = own.select("id", "n", F.size(F.filter("o", lambda x: ~x["h"])).alias("c"), F.slice("o.s", 1, F.col("p")).alias("first"))
    each = known.unionAll(own).select("id", "n", "c", F.posexplode("first").alias("pos", "s"))
    return each.select("s", "pos", (F.col("pos") >= F.col("c")).alias("h"), "id", "n")


def told_apart(reps: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, n, p, more, hot, cold): the stored shingles in two, each in its order; the hot ones (HOT_SENT at most) are sent to the executors."""
    sent = reps.sparkSession.sparkContext.broadcast(np.sort(np.array([r["s"] for r in hot.collect()], dtype=np.int64)))

    def run(batches):
        import pyarrow as pa

        last = sent.value
        for batch in batches:
            pre = batch.column(4)
            at, v = pre.offsets.to_numpy().astype(np.int64), pre.flatten().to_numpy()
            at = at - at[0]
            h = last[np.minimum(np.searchsorted(last, v), len(last) - 1)] == v if len(last) else np.zeros(len(v), dtype=bool)
            hot_at = np.concatenate([[0], np.cumsum(h)])[at]
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x)) for o, x in ((hot_at, v[h]), (at - hot_at, v[~h]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], ["id", "n", "p", "more", "hot", "cold"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "n", "p", "more", "pre").mapInArrow(run, f"id {kind}, n long, p int, more boolean, hot array<bigint>, cold array<bigint>")


def told_apart_by_join(reps: DataFrame, hot: DataFrame) -> DataFrame:
    """The same where there are too many hot shingles to send."""
    theirs = with_hot(reps.select("id", F.explode("pre").alias("s")), hot, "inner").groupBy("id").agg(F.collect_set("s").alias("hot"))
    r = reps.join(theirs, "id", "left").withColumn("hot", F.array_intersect("pre", F.coalesce("hot", F.array().cast("array<bigint>"))))
    return r.select("id", "n", "p", "more", "hot", F.array_except("pre", "hot").alias("cold"))


def with_hot(rows: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """Rows (id, s) joined to the hot shingles, of which each may have a large part of all rows: in SALTS parts by id."""
    parts = for_salts(hot.select("s", F.lit(True).alias("h"), F.lit(True).alias("hit")))
    return salted(rows.withColumn("h", F.lit(True))).join(parts, ["s", "salt"], how).drop("salt", "h")


def ordered_first(docs: DataFrame, deep: DataFrame, hot: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(id, n, c, first) of the classes (id, n, p): the first shingles in the order with hot ones last, c of all are not hot; the hot ones (HOT_SENT at most) are sent to the executors."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["s"] for r in hot.collect()], dtype=np.int64)))

    def run(batches):
        import pyarrow as pa

        last = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out, cold, sizes = batch.slice(at, 256), [], [], []
                for t in part.column(1):
                    g = shingles(t.as_py(), size)
                    h = np.isin(g, last, assume_unique=True)
                    out.append(np.concatenate([g[~h], g[h]])[: prefix(len(g), num, den)])
                    cold.append(int(len(g) - h.sum()))
                    sizes.append(len(g))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(cold, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["id", "n", "c", "first"])

    kind = docs.schema["id"].dataType.simpleString()
    made = docs.join(deep.select("id"), "id", "left_semi").select("id", "text").mapInArrow(run, f"id {kind}, n long, c int, first array<bigint>")
    return made.join(deep, ["id", "n"], "left_semi").dropDuplicates(["id"])


def every_shingle(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, s): all shingles of the documents in ``ids``, a row each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                g = shingles(t.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(g), type=batch.column(0).type), pa.array(g)], ["id", "s"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, f"id {kind}, s long")


def shingle_counts(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(s, k): in how many of the documents in ``ids`` each shingle is, added up by task as far as HELD of them go."""

    def run(batches):
        import pyarrow as pa

        def flushed(held):
            s, k = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(k)], ["s", "k"])

        held, n = [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(shingles(t.as_py(), size))
                n += len(held[-1])
                if n > HELD:
                    yield flushed(held)
                    held, n = [], 0
        if held:
            yield flushed(held)

    return docs.join(ids, "id", "left_semi").select("text").mapInArrow(run, "s long, k long")


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) of class ids those that link: bit counts first, then the sets."""
    bits = reps.select("id", "n", "bits")
    kind = docs.schema["id"].dataType.simpleString()
    carried = pairs.join(bits.toDF("a", "na", "wa"), "a").join(bits.toDF("b", "nb", "wb"), "b").select("a", "b", "na", "wa", "nb", "wb")

    def bound(batches):
        for batch in batches:
            na, wa, nb, wb = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            ok = [may_link(p, np.frombuffer(q, np.uint8), r, np.frombuffer(s, np.uint8), num, den) for p, q, r, s in zip(na, wa, nb, wb)]
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = written(carried.mapInArrow(bound, f"a {kind}, b {kind}"), "near-pairs")
    ids = near.select(F.col("a").alias("id")).unionAll(near.select("b")).distinct()
    sets = written(sets_of(docs, ids, size), "near-sets")
    full = near.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ok = [links(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), num, den) for x, y in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with arrow_rows(docs.sparkSession, 500):  # a row holds two sets
        return written(full.mapInArrow(exact, f"a {kind}, b {kind}").distinct(), "links")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the links (a, b) reach from each id in them.

    Rounds of the smallest neighbouring label and a jump to the label's own label, each written,
    until nothing changes.
    """
    edges = written(pairs.select("a", "b").unionAll(pairs.select("b", "a")), "edges")
    now = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("id"), "c"), "labels")
    while True:
        near = edges.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = now.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        own = now.select(F.col("id").alias("c"), F.col("c").alias("j"))
        new = written(low.join(own, "c").select("id", "was", F.least("c", "j").alias("c")), "labels")
        changed = new.filter(F.col("c") != F.col("was")).limit(1).count()
        now = new.select("id", "c")
        if not changed:
            return now.withColumnRenamed("c", "component")


def salted(rows: DataFrame) -> DataFrame:
    """Rows of hot shingles in SALTS parts, by their ids."""
    return rows.withColumn("salt", F.when(F.col("h"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))


def for_salts(known: DataFrame) -> DataFrame:
    """What is known of a shingle, once for each part of its rows."""
    return known.withColumn("salt", F.explode(F.when(F.col("h"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("h")


def with_bands(t: DataFrame) -> DataFrame:
    """Rows as members of their own band's tile and, as upper ones, of the tile of the band below: a tile meets itself and the next band."""
    own = F.struct(F.col("band"), F.col("left"))
    below = F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("left"))
    return t.withColumn("x", F.explode(F.array(own, below))).select("s", "x.band", "x.left", "h", "pos", "id", "n", "component")


def open_tiles(t: DataFrame) -> DataFrame:
    """The rows of tiles with a left row and more than one component, and the tile's counts.

    rows, minors: all rows and those outside the main (largest) component; major_left,
    minor_left: left rows within and outside it.
    """
    known = (
        t.groupBy("s", "band", "component").agg(F.count("*").alias("k"), F.count_if("left").alias("l"), F.max("h").alias("h"))
        .groupBy("s", "band").agg(F.count("*").alias("parts"), F.sum("k").alias("rows"), F.sum("l").alias("lefts"), F.max(F.struct("k", "component", "l")).alias("main"), F.max("h").alias("h"))
        .filter("parts > 1 and lefts > 0")
        .select("s", "band", "h", "rows", (F.col("rows") - F.col("main.k")).alias("minors"), F.col("main.l").alias("major_left"), (F.col("lefts") - F.col("main.l")).alias("minor_left"), F.col("main.component").alias("main"))
    )
    return salted(t).join(for_salts(known), ["s", "band", "salt"]).drop("salt")


def small_tile_pairs(t: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of similar size and different components in tiles of up to HOT rows, whose common shingle leaves room for a link."""
    a = t.filter("left").select("s", "band", *(F.col(c).alias(f"a_{c}") for c in ("id", "n", "pos", "component")))
    b = t.select("s", "band", *(F.col(c).alias(f"b_{c}") for c in ("id", "n", "pos", "component")))
    order = F.struct("a_n", "a_id") < F.struct(F.col("b_n").alias("a_n"), F.col("b_id").alias("a_id"))
    size = (F.col("a_n") * den >= F.col("b_n") * num) & (F.col("a_component") != F.col("b_component"))
    room = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) * (num + den) >= (F.col("a_n") + F.col("b_n")) * num
    pairs = a.join(b, ["s", "band"]).filter(order & size & room)
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def wide_bitmap(g: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=bool)
    out[g & (bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def block_links(left: list, right: list, num: int, den: int) -> list[tuple]:
    """Links (i, j) that join the components of two blocks of rows (id, component, sorted shingles).

    Pairs whose components are already joined here are passed over, so a block yields fewer links
    than it has components, however dense it is. Bit counts over bitmaps of about 16 bits a
    shingle come before the intersections.
    """
    if not left or not right:
        return []
    bits = 1 << min(17, max(10, (16 * max(len(r[2]) for r in right) - 1).bit_length()))
    maps = np.array([wide_bitmap(r[2], bits) for r in right])
    n = np.array([len(r[2]) for r in right], dtype=np.int64)
    names = {c: k for k, c in enumerate(dict.fromkeys([r[1] for r in left] + [r[1] for r in right]))}
    parent = np.arange(len(names))
    of = np.array([names[r[1]] for r in right])

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, c, g in left:
        c, w = root(names[c]), wide_bitmap(g, bits)
        at = np.flatnonzero((np.minimum(n, len(g)) * den >= np.maximum(n, len(g)) * num) & (of != c))
        if not len(at):
            continue
        both = np.minimum(len(g) - np.bitwise_count(w & ~maps[at]).sum(axis=1, dtype=np.int64), n[at] - np.bitwise_count(maps[at] & ~w).sum(axis=1, dtype=np.int64))
        sure = np.argsort(-both, kind="stable")
        at, both = at[sure], both[sure]
        for k in at[both * (num + den) >= num * (n[at] + len(g))]:
            other = root(of[k])
            if other != c and links(g, right[k][2], num, den):
                out.append((min(i, right[k][0]), max(i, right[k][0])))
                parent[other] = c
                of[of == other] = c
    return out


def block_survivors(left: list, right: list, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (id, component, n, pos, bitmap) of two blocks have a partner that bit counts and places do not rule out."""
    keep, found = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
    if not left or not right:
        return keep, found
    size = min(len(r[4]) for r in left + right)
    maps = np.array([fold(r[4], size).view(np.uint64) for r in right])
    n, pos = (np.array([r[c] for r in right], dtype=np.int64) for c in (2, 3))
    names = {c: k for k, c in enumerate(dict.fromkeys(r[1] for r in left + right))}
    of = np.array([names[r[1]] for r in right])
    for k, (_, c, m, q, bits) in enumerate(left):
        w = fold(bits, size).view(np.uint64)
        room = np.minimum(m - q, n - pos) * (num + den) >= num * (m + n)
        at = np.flatnonzero((m <= n) & (m * den >= n * num) & (of != names[c]) & room)
        if len(at):
            both = np.minimum(m - np.bitwise_count(w & ~maps[at]).sum(axis=1, dtype=np.int64), n[at] - np.bitwise_count(maps[at] & ~w).sum(axis=1, dtype=np.int64))
            at = at[both * (num + den) >= num * (n[at] + m)]
            keep[k] = len(at) > 0
            found[at] = True
    return keep, found


def large_tile_links(docs: DataFrame, reps: DataFrame, large: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links that join the components in tiles above HOT rows.

    Two grids of blocks of about BLOCK rows a tile: left rows outside the main component against
    all rows, and those within it against the rows outside. Blocks first meet as bitmaps; sets are
    sent only for the rows that have a partner left.
    """
    kind = docs.schema["id"].dataType.simpleString()
    minor = F.col("component") != F.col("main")
    t = large.withColumn("a1", F.ceil(F.col("minor_left") / BLOCK).cast("int")).withColumn("b1", F.ceil(F.col("rows") / BLOCK).cast("int"))
    t = t.withColumn("a2", F.ceil(F.col("major_left") / BLOCK).cast("int")).withColumn("b2", F.ceil(F.col("minors") / BLOCK).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    sides = []
    for grid, left, right in ((1, F.col("left") & minor, F.col("a1") > 0), (2, F.col("left") & ~minor, minor & (F.col("a2") > 0))):
        a, b = f"a{grid}", f"b{grid}"
        own = [F.lit(grid).alias("grid"), "id", "n", "pos", "component"]
        sides.append(t.filter(left).select("s", "band", F.lit(True).alias("side"), *own, mine(a).alias("l"), upto(b).alias("r")))
        sides.append(t.filter(right).select("s", "band", F.lit(False).alias("side"), *own, mine(b).alias("r"), upto(a).alias("l")).select(*sides[-1].columns))
    cells = sides[0].unionAll(sides[1]).unionAll(sides[2]).unionAll(sides[3])
    key = ["s", "band", "grid", "l", "r"]

    def bound(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        side = table.column("side").to_numpy(zero_copy_only=False)
        cols = [table.column(c).to_pylist() for c in ("id", "component", "n", "pos")]
        rows = list(zip(*cols, (np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist())))
        keep = np.zeros(len(rows), dtype=bool)
        keep[side], keep[~side] = block_survivors([x for x, y in zip(rows, side) if y], [x for x, y in zip(rows, side) if not y], num, den)
        return pc.filter(table.select([*key, "side", "id", "component"]).combine_chunks(), pa.array(keep))

    met = cells.join(reps.select("id", "bits"), "id").groupBy(*key).applyInArrow(bound, f"s long, band int, grid int, l int, r int, side boolean, id {kind}, component {kind}")
    met = written(met, "block-rows")
    sets = written(sets_of(docs, met.select("id").distinct(), size), "block-sets")

    def block(table):
        import pyarrow as pa

        rows = list(zip(table.column("id").to_pylist(), table.column("component").to_pylist(), (np.frombuffer(x, np.int64) for x in table.column("g").to_pylist())))
        side = table.column("side").to_pylist()
        found = block_links([r for r, x in zip(rows, side) if x], [r for r, x in zip(rows, side) if not x], num, den)
        id_type = table.column("id").type
        return pa.table({"a": pa.array([x for x, _ in found], id_type), "b": pa.array([x for _, x in found], id_type)})

    return written(met.join(sets, "id").groupBy(*key).applyInArrow(block, f"a {kind}, b {kind}"), "block-links")


def join_classes(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (id, n, k1, k2, ...) and the component c of each class (k1, k2) with shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())
    with arrow_rows(docs.sparkSession, 2000):
        signed = written(sign(rows, size, num, den), "signed")
    reps = written(
        signed.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "pre", "more", "bits")).alias("r")).select("k1", "k2", "r.*"), "classes"
    )
    band = F.floor(F.log("n") / (math.log(den / num) * 1.0001)).cast("int")
    left = F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * num / F.lit(float(num + den)) - F.lit(1e-9)).cast("long")
    first = first_shingles(rows, reps, size, num, den).withColumn("band", band).withColumn("left", left)
    shared = first.groupBy("s").agg(F.count("*").alias("c"), F.max("left").alias("any"), F.max("h").alias("h")).filter("c > 1 and any").select("s", "h")
    tiles = written(salted(first).join(for_salts(shared), ["s", "salt"]).drop("salt"), "tiles")
    pivots = tiles.filter("left").groupBy("s", "band").agg(F.min(F.struct("n", "id")).alias("p"), F.max("h").alias("h")).select("s", "band", "h", F.col("p.id").alias("a"), F.col("p.n").alias("na"))
    close = (F.col("id") != F.col("a")) & (F.col("na") <= F.col("n")) & (F.col("na") * den >= F.col("n") * num)
    stars = salted(tiles).join(for_salts(pivots), ["s", "band", "salt"]).filter(close).select("a", F.col("id").alias("b")).distinct()
    found = verify(rows, reps, stars, size, num, den)
    labels = components(found)
    placed = tiles.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = written(open_tiles(with_bands(placed)), "open-tiles")
    more = verify(rows, reps, small_tile_pairs(rest.filter(F.col("rows") <= HOT), num, den), size, num, den)
    dense = large_tile_links(rows, reps, rest.filter(F.col("rows") > HOT), size, num, den)
    labels = components(found.unionAll(more).unionAll(dense))
    classes = reps.select("k1", "k2", F.col("id").alias("rep")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return signed, classes.select("k1", "k2", F.coalesce("component", "rep").alias("c"))


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(<id_col>, n_shingles long, component_id), a row for each row of ``docs`` with an id; see ``near_duplicates``."""
    signed, classes = join_classes(docs, id_col, text_col, size, num, den)
    out = signed.select("id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with component_id: the smallest id reachable by links, itself included.

    A document's set is that of its distinct ``size``-word shingles; two documents link when
    den * intersection >= num * union. The join is exact. Null and empty texts and texts without
    words have no shingles and no links. Rows that share an id but not a text share the smaller
    component. Rows with a null id take no part and have a null component. A column called
    component_id is replaced. An empty table gives an empty result.
    """
    docs = docs.drop("component_id")
    ids = component_ids(docs, id_col, text_col, size=size, num=num, den=den)
    key, c = free_name(docs, "key"), free_name(docs, "component")
    of = ids.groupBy(F.col(id_col).alias(key)).agg(F.min("component_id").alias(c))
    return docs.join(of, F.col(id_col) == F.col(key), "left").withColumn("component_id", F.col(c)).drop(c, key)

"""Hard-negative mining by dual-tree search over integer vectors.

Candidates and anchors are both held in ball trees: rows sorted by label and by the signs of seeded
random planes are cut into stretches, and each stretch is split down to leaves; a node
knows its centre, radius, and the range of its labels. For a node of anchors and one of candidates
the inner products lie between a*c - r and a*c + r with r = Ra|c| + Rc|a| + RaRc. A pair of nodes whose
interval cannot help any of its anchors is passed over whole: first on the level of whole trees, as
a table of pairs of roots, then inside tasks down to pairs of leaves, which are scored exactly.

Two searches follow each other. The first finds an anchor's nearest rows of its own label, its
positives; the second, for each positive, the highest scores of other labels inside the band that
the positive's score opens, so its intervals are cut from both sides.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .ann import matrix
from .shared import written

#: Rows of a candidate tree, anchors of an anchor tree, rows of a leaf of each, bytes of trees in a task, planes of the sort.
TREE, BLOCK, LEAF, ANCHOR_LEAF, CELL_BYTES, PLANES = 2048, 1024, 64, 32, 32 << 20, 12
SEED = 13


def ball_tree(v: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, nodes (start, stop, left, right), centres, radii); a leaf has no children (-1)."""
    order, nodes, centres, radii = np.arange(len(v)), [], [], []
    todo = [(0, len(v), -1, 0)]
    while todo:
        start, stop, parent, side = todo.pop()
        mine = v[order[start:stop]]
        centre = mine.mean(axis=0)
        at = len(nodes)
        nodes.append([start, stop, -1, -1])
        centres.append(centre)
        radii.append(math.sqrt(((mine - centre) ** 2).sum(axis=1).max()))
        if parent >= 0:
            nodes[parent][2 + side] = at
        if stop - start > leaf and radii[-1] > 0:
            own = labels[order[start:stop]]
            # a node of several labels is split by them first, so that its children tell labels apart
            by = own if own.min() != own.max() else mine[:, (mine.max(axis=0) - mine.min(axis=0)).argmax()]
            turn = np.argsort(by, kind="stable")
            order[start:stop] = order[start:stop][turn]
            # in the middle of the values, which keeps groups whole, but with an eighth of the rows on either side
            half, eighth = np.searchsorted(by[turn], (by.min() + by.max()) / 2, side="right"), max(1, (stop - start) // 8)
            half = int(min(max(half, eighth), stop - start - eighth))
            todo += [(start, start + half, at, 0), (start + half, stop, at, 1)]
    return order, np.array(nodes, dtype=np.int32), np.array(centres), np.array(radii)


class Tree:
    """A tree as it is sent: ids, labels, vectors and nodes."""

    def __init__(self, row: dict, dim: int):
        self.dim = dim
        self.ids, self.labels = np.array(row["ids"]), np.array(row["labels"])
        self.v = np.frombuffer(row["v"], dtype=np.int32).reshape(-1, dim)
        self.nodes = np.frombuffer(row["nodes"], dtype=np.int32).reshape(-1, 4)
        self.centres = np.frombuffer(row["centres"]).reshape(-1, dim)
        self.radii = np.frombuffer(row["radii"])
        self.norms = np.sqrt((self.centres * self.centres).sum(axis=1))
        self.low = np.array([self.labels[a:b].min() for a, b, *_ in self.nodes])
        self.high = np.array([self.labels[a:b].max() for a, b, *_ in self.nodes])
        self.leaf = self.nodes[:, 2] < 0

    def least(self, x: np.ndarray) -> np.ndarray:
        """The smallest of a value of the rows, by node."""
        return np.array([x[a:b].min() for a, b, *_ in self.nodes])


def leaf_pairs(a: Tree, c: Tree, need: np.ndarray, most: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of anchors and candidates whose intervals reach a row's need and do not lie above all that it may take."""
    need, most = a.least(need), -a.least(-most)
    x, y = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    out = []
    while len(x):
        dot = (a.centres[x] * c.centres[y]).sum(axis=1)
        reach = a.radii[x] * c.norms[y] + c.radii[y] * a.norms[x] + a.radii[x] * c.radii[y]
        slack = 1 + 1e-9 * (np.abs(dot) + reach)
        keep = (dot + reach + slack >= need[x]) & (dot - reach - slack <= most[x])
        if same:
            keep &= (a.low[x] <= c.high[y]) & (c.low[y] <= a.high[x])
        else:
            keep &= ~((a.low[x] == a.high[x]) & (c.low[y] == c.high[y]) & (a.low[x] == c.low[y]))
        x, y = x[keep], y[keep]
        ends = a.leaf[x] & c.leaf[y]
        out.append((x[ends], y[ends]))
        x, y = x[~ends], y[~ends]
        # of two nodes the wider one is opened, or the one that can be
        first = ~a.leaf[x] & (c.leaf[y] | (a.radii[x] >= c.radii[y]))
        xs, ys = a.nodes[x[first], 2:], c.nodes[y[~first], 2:]
        x, y = np.concatenate([xs.ravel(), np.repeat(x[~first], 2)]), np.concatenate([np.repeat(y[first], 2), ys.ravel()])
    return tuple(np.concatenate(z) for z in zip(*out))


class Best:
    """The best k (score, smaller id first) of each slot; ``floor`` is the score that still counts."""

    def __init__(self, floor: np.ndarray, k: int, id_type):
        self.k, self.floor = k, floor
        self.slot, self.id, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=id_type), np.zeros(0, dtype=np.int64)

    def add(self, slot, ids, score) -> None:
        touched = np.isin(self.slot, slot)
        s, i, x = np.concatenate([self.slot[touched], slot]), np.concatenate([self.id[touched], ids]), np.concatenate([self.score[touched], score])
        order = np.lexsort((i, -x, s))
        s, i, x = s[order], i[order], x[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s, side="left")
        full = rank == self.k - 1
        self.floor[s[full]] = np.maximum(self.floor[s[full]], x[full])
        keep = rank < self.k
        self.slot, self.id, self.score = (np.concatenate([p[~touched], q[keep]]) for p, q in ((self.slot, s), (self.id, i), (self.score, x)))


def inner(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2^53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ c.astype(np.int64).T


def search(a: Tree, trees: list[Tree], k: int, bands: dict | None) -> tuple[Best, int]:
    """The best k of every anchor (same label), or of every band of it (other labels), and the number of products formed.

    ``bands``: for each anchor's place in the tree its (low, high) limits, as arrays of shape
    (anchors, bands); unused bands have low above high.
    """
    n, lowest = len(a.ids), np.iinfo(np.int64).min // 4
    low, high = bands or (np.full((n, 1), lowest), np.full((n, 1), -lowest))
    width = low.shape[1]
    best, scored = Best(low.ravel().copy(), k, a.ids.dtype), 0
    used = low <= high
    most = np.where(used, high, lowest).max(axis=1)
    root = np.array([a.centres[0] @ t.centres[0] + a.radii[0] * t.norms[0] + t.radii[0] * (a.norms[0] + a.radii[0]) for t in trees])
    for at in np.argsort(-root, kind="stable"):
        c = trees[at]
        need = np.where(used, best.floor.reshape(n, width), -lowest).min(axis=1)
        x, y = leaf_pairs(a, c, need, most, bands is None)
        for leaf in np.unique(x):
            start, stop = a.nodes[leaf, :2]
            columns = np.concatenate([np.arange(*c.nodes[j, :2]) for j in y[x == leaf]])
            score = inner(a.v[start:stop], c.v[columns])
            scored += score.size
            labels = a.labels[start:stop, None] == c.labels[columns][None]
            fit = labels & (a.ids[start:stop, None] != c.ids[columns][None]) if bands is None else ~labels
            for b in range(width):
                slots = np.arange(start, stop) * width + b
                row, column = np.nonzero(fit & (score >= best.floor[slots][:, None]) & (score <= high[start:stop, b][:, None]))
                if len(row):
                    best.add(slots[row], c.ids[columns[column]], score[row, column])
    return best, scored


def planted(rows: DataFrame, per: int, leaf: int, dim: int, least_parts: int) -> DataFrame:
    """Trees of at most ``per`` rows: (tree, n, low, high, centre, radius, ids, labels, v, nodes, centres, radii), written.

    ``tree`` is unique. Partitions follow label, plane signs and id, so neither a label nor a
    group of equal vectors has to fit into one.
    """
    import pyarrow as pa

    spark, kind, label_kind = rows.sparkSession, rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    count = rows.count()
    parts = max(1, math.ceil(count / (16 * per)), min(least_parts, count // leaf))

    def pack(rows: pa.Table):
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        v = matrix(rows.column("v").combine_chunks(), dim)
        order, nodes, centres, radii = ball_tree(v.astype(np.float64), labels, leaf)
        return {
            "n": len(ids), "low": labels.min(), "high": labels.max(), "centre": centres[0].tolist(), "radius": radii[0], "ids": ids[order].tolist(), "labels": labels[order].tolist(),
            "v": v[order].astype(np.int32).tobytes(), "nodes": nodes.tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes(),
        }

    def plant(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            while held.num_rows >= per:
                yield pa.RecordBatch.from_pylist([pack(held.slice(0, per))], schema)
                held = held.slice(per)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([pack(held)], schema)

    fields = f"n int, low {label_kind}, high {label_kind}, centre array<double>, radius double, ids array<{kind}>, labels array<{label_kind}>, v binary, nodes binary, centres binary, radii binary"
    schema = to_arrow_schema(StructType.fromDDL(fields))
    keys = ["label", "code", "id"]
    out = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "label", "v").mapInArrow(plant, fields)
    return written(out.withColumn("tree", F.monotonically_increasing_id()), "trees")


def quantised(df: DataFrame, id_col: str, label_col: str, vec_col: str, anchor: Column, scale: int, dim: int | None) -> tuple[DataFrame, int]:
    """(id, label, v of whole numbers, anchor, code) of the rows that take part, one for each id, written; and the number of components."""
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.dropna(subset=["id", "label", "v"]).filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0))
    if dim is None:
        top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top["n"] if top else 1
    # products of components stay below 2^62 / dim, so that a score fits 64 bits, and a component 32
    limit = min(2**31 - 1, math.isqrt(2**62 // dim))
    rows = rows.filter(F.size(v) == dim).withColumn("v", F.transform(v, lambda x: F.floor(x * scale))).filter(F.forall(v, lambda x: F.abs(x) <= limit))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    planes = np.random.default_rng(SEED).standard_normal((dim, PLANES))

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                bits = (matrix(batch.column("v"), dim).astype(np.float64) @ planes > 0) @ (1 << np.arange(PLANES)[::-1])
                yield batch.append_column("code", pa.array(bits.astype(np.int32)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema)
    return written(one.mapInArrow(sign, f"{kinds}, code int"), "mined-rows"), dim


def interval(pairs: DataFrame) -> DataFrame:
    """Pairs of roots with the least and the largest inner product that their rows can have."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(F.col(a), F.col(a)))
    reach = F.col("a_radius") * norm("centre") + F.col("radius") * norm("a_centre") + F.col("a_radius") * F.col("radius")
    mid = dot(F.col("a_centre"), F.col("centre"))
    slack = 1 + F.lit(1e-9) * (F.abs(mid) + reach)
    return pairs.withColumns({"least": mid - reach - slack, "largest": mid + reach + slack}).drop("a_centre", "a_radius", "centre", "radius")


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", *, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256, dim: int | None = None, tree_rows: int = TREE, block_rows: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    A component x becomes floor(scale * x); a score is the inner product of whole numbers. Rows where
    ``anchor`` holds are the anchors. A positive is one of the ``positives`` best other rows of the
    anchor's label; its negatives are the ``negatives`` best rows of other labels whose score is
    between ``low`` and ``high`` percent of its own. Higher scores come first, ties by smaller id.
    Anchors without positives, and positives without a row in the band, have no row. Left out are
    rows with a null id, label, vector or component, non-finite ones, vectors of another length than
    ``dim`` (default: the most frequent), empty ones, and such large ones that scores would not
    fit 64 bits. Labels and ids are numbers. Rows that share an id are one row, the one with the
    smallest label and vector. Empty tables give an empty result.
    """
    spark = df.sparkSession
    rows, dim = quantised(df, id_col, label_col, vec_col, anchor, scale, dim)
    cores = 2 * spark.sparkContext.defaultParallelism
    trees = planted(rows, tree_rows, LEAF, dim, cores)
    blocks = planted(rows.filter("anchor"), block_rows, ANCHOR_LEAF, dim, 1).withColumnRenamed("tree", "block")
    per_cell = max(1, CELL_BYTES // (4 * dim * tree_rows))
    cells = max(1, math.ceil(trees.count() / per_cell), cores)
    # every pair of roots: one short row for block_rows anchors and tree_rows candidates
    many = max(1, blocks.count())
    asked = blocks.select("block", F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("centre").alias("a_centre"), F.col("radius").alias("a_radius"))
    asked = asked.withColumn("at", F.pmod(F.xxhash64("block"), F.lit(many)).cast("int"))
    roots = trees.select("tree", "n", "low", "high", "centre", "radius").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    pairs = written(interval(roots.join(asked, "at")).drop("at"), "mined-pairs")
    pure = (F.col("low") == F.col("high")) & (F.col("a_low") == F.col("a_high")) & (F.col("low") == F.col("a_low"))
    kind = rows.schema["id"].dataType.simpleString()

    def searched(pairs: DataFrame, blocks: DataFrame, k: int, banded: bool, fields: str) -> DataFrame:
        import pyarrow as pa

        def cell(own, theirs):
            out = []
            if own.num_rows and theirs.num_rows:
                block = own.to_pylist()[0]
                a, found = Tree(block, dim), [Tree(t, dim) for t in theirs.select(["ids", "labels", "v", "nodes", "centres", "radii"]).to_pylist()]
                bands = wanted = None
                if banded:
                    place, width = {i: p for p, i in enumerate(a.ids.tolist())}, positives
                    bands = np.full((len(a.ids), width), 1), np.full((len(a.ids), width), 0)
                    wanted = {}
                    for p in block["bands"]:
                        at, b, score = place[p["anchor_id"]], p["rank"] - 1, p["score"]
                        bands[0][at, b], bands[1][at, b] = -(-low * score // 100), high * score // 100
                        wanted[at * width + b] = (p["id"], score)
                best, _ = search(a, found, k, bands)
                for slot, i, score in zip(best.slot.tolist(), best.id.tolist(), best.score.tolist()):
                    out.append((a.ids[slot].item(), i, score) if not banded else (a.ids[slot // positives].item(), *wanted[slot], i, score))
            return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)] if out else [pa.nulls(0, f.type) for f in schema], schema=schema)

        schema = to_arrow_schema(StructType.fromDDL(fields))
        asked = pairs.select("tree", "block").withColumn("cell", F.pmod(F.xxhash64("tree"), F.lit(cells)))
        theirs = asked.join(trees, "tree")
        own = asked.select("block", "cell").distinct().join(blocks, "block").withColumnsRenamed({"block": "own_block", "cell": "own_cell"})
        return own.groupBy("own_block", "own_cell").cogroup(theirs.groupBy("block", "cell")).applyInArrow(cell, fields)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # a block of one label has, in a tree of that label with enough rows, this many scores of at least the interval's least
    enough = pairs.filter(pure & (F.col("n") > positives)).groupBy("block").agg(F.max("least").alias("bound"))
    near = pairs.filter("a_low <= high and low <= a_high").join(enough, "block", "left").filter("bound is null or largest >= bound")
    found = searched(near, blocks, positives, False, f"anchor_id {kind}, id {kind}, score bigint")
    chosen = written(first(found, ["anchor_id"], positives), "mined-positives")

    places = blocks.select("block", F.explode("ids").alias("anchor_id"))
    band, exact = F.struct("anchor_id", "id", "score", "rank"), F.col("score").cast("double")
    bands = chosen.join(places, "anchor_id").groupBy("block").agg(F.collect_list(band).alias("bands"), F.min(exact * low / 100).alias("needed"), F.max(exact * high / 100).alias("allowed"))
    banded = blocks.join(bands, "block")
    open_ = pairs.filter(~pure).join(bands.drop("bands"), "block").filter("largest >= needed and least <= allowed")
    fields = f"anchor_id {kind}, positive_id {kind}, positive_score bigint, id {kind}, score bigint"
    negatives_ = first(searched(open_, banded, negatives, True, fields), ["anchor_id", "positive_id"], negatives)
    return negatives_.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

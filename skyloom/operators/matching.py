"""Feature matching between the images of a pair, as one plan of joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import settled

#: Rows of one tile of descriptors; two tiles meet as one matrix.
TILE = 2048


def two_nearest(left: DataFrame, right: DataFrame, by: str, tile: int = TILE, apart: bool = False) -> DataFrame:
    """(by, i, j, d, rn): the two nearest right descriptors of each left one among those of the same ``by``; ties to the smaller j.

    Both have (by, id, vec). Tiles of both sides meet as cells, and a cell leaves two rows a left
    descriptor, so the pairs of a group are never rows. Distances are Euclidean in double
    precision. ``apart``: a row is not its own neighbour.
    """
    kinds = {c: left.schema[c].dataType.simpleString() for c in (by, "id")}

    def cut(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy(by).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("n"))
        rows = df.join(n, by).select(F.col(by).alias(f"by{name}"), F.col("id").alias(f"id{name}"), F.col("vec").alias(f"vec{name}"), F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias(f"t{name}"))
        return rows, n

    (a, na), (b, nb) = cut(left.select(by, "id", "vec"), "a"), cut(right.select(by, "id", "vec"), "b")
    upto = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = a.join(nb.withColumnRenamed(by, "bya"), "bya").withColumn("ta2", upto)
    b = b.join(na.withColumnRenamed(by, "byb"), "byb").withColumn("tb2", upto)

    def cell(x, y):
        import pyarrow as pa

        rows = [[], [], [], []]
        if x.num_rows and y.num_rows:
            ids, others = x.column("ida").to_numpy(), y.column("idb").to_numpy()
            order = np.argsort(others, kind="stable")
            others, m = others[order], np.array(y.column("vecb").to_pylist(), dtype=float)[order]
            own, group = np.array(x.column("veca").to_pylist(), dtype=float), x.column("bya")[0].as_py()
            # squares by one product, close enough to choose a few; those are measured exactly
            rough = (own**2).sum(axis=1)[:, None] - 2 * own @ m.T + (m**2).sum(axis=1)[None]
            if apart:
                rough[ids[:, None] == others[None]] = np.inf
            slack = 1e-9 * (1 + (own**2).sum(axis=1) + (m**2).sum(axis=1).max())
            second = np.partition(rough, min(1, len(others) - 1), axis=1)[:, : min(2, len(others))].max(axis=1)
            second = np.where(np.isfinite(second), second, rough.min(axis=1))
            at, k = np.nonzero((rough <= (second + slack)[:, None]) & np.isfinite(rough))
            d = np.sqrt(((m[k] - own[at]) ** 2).sum(axis=1))
            order = np.lexsort((k, d, at))
            at, k, d = at[order], k[order], d[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < 2
            rows = [[group] * int(keep.sum()), ids[at[keep]], others[k[keep]], d[keep]]
        types = [x.schema.field("bya").type, x.schema.field("ida").type, x.schema.field("ida").type, pa.float64()]
        return pa.table([pa.array(c, type=t) for c, t in zip(rows, types)], [by, "i", "j", "d"])

    pairs = a.drop("n").groupBy("bya", "ta", "ta2").cogroup(b.drop("n").groupBy("byb", "tb2", "tb"))
    near = pairs.applyInArrow(cell, f"{by} {kinds[by]}, i {kinds['id']}, j {kinds['id']}, d double")
    w = Window.partitionBy(by, "i").orderBy("d", "j")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")


#: The eight cells around a cell in turning order; two rings that differ by k places are turned by k eighths.
RING = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))


def voted(m: DataFrame, by: str, size: tuple[float, float], grid: int = 20, factor: float = 5.0) -> DataFrame:
    """Matches (by, i, u1, v1, u2, v2, ...) that their neighbourhood votes for, under the turn that keeps most of a pair's.

    Both images of ``size`` are cut into ``grid`` by ``grid`` cells. Matches from one left cell to one
    right cell are a motion; its support under a turn is its own number and that of the motions from
    the eight left cells around to the right cells around that lie where the turn puts them. It
    stands where the support is above ``factor`` times the root of the mean number of matches in the
    nine left cells. Left cells are laid out four times, moved by half a cell along either side and
    both; a match stays if its motion stands in any layout. Of the eight turns by 45 degrees the one
    that keeps most matches of the pair counts, of equal ones the smallest.
    """
    w, h = size[0] / grid, size[1] / grid
    layouts = F.array(*(F.struct(F.lit(k).alias("layout"), F.lit(x / 2).alias("x"), F.lit(y / 2).alias("y")) for k, (x, y) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))))
    laid = m.select(by, "i", "u1", "v1", "u2", "v2", F.explode(layouts).alias("l"))
    cell = lambda c, side, off=None: F.floor(F.col(c) / side + (F.col(off) if off else 0)).alias(f"c{c}")
    left, right = ["cu1", "cv1"], ["cu2", "cv2"]
    laid = laid.select(by, "i", F.col("l.layout").alias("layout"), cell("u1", w, "l.x"), cell("v1", h, "l.y"), cell("u2", w), cell("v2", h))
    motions = laid.groupBy(by, "layout", *left, *right).agg(F.count("*").alias("n"))
    # what a motion gives to the eight around its left cell, which see it on the other side of their ring
    ring = F.array(*(F.struct(F.lit(k).alias("p"), F.lit(-x).alias("x"), F.lit(-y).alias("y")) for k, (x, y) in enumerate(RING)))
    around = motions.withColumn("r", F.explode(ring)).select(by, "layout", (F.col("cu1") + F.col("r.x")).alias("cu1"), (F.col("cv1") + F.col("r.y")).alias("cv1"), F.col("r.p").alias("p"), F.col("cu2").alias("su"), F.col("cv2").alias("sv"), "n")
    mass = around.groupBy(by, "layout", *left).agg(F.sum("n").alias("around"))
    # the same by right cell: a place q of the right ring, met by place p of the left one, is a turn of q - p
    given = around.withColumn("r", F.explode(ring)).select(by, "layout", *left, (F.col("su") + F.col("r.x")).alias("cu2"), (F.col("sv") + F.col("r.y")).alias("cv2"), F.pmod(F.col("r.p") - F.col("p"), F.lit(8)).alias("turn"), "n")
    given = given.groupBy(by, "layout", *left, *right, "turn").agg(F.sum("n").alias("given"))
    own = motions.groupBy(by, "layout", *left).agg(F.sum("n").alias("own"))
    each = motions.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(7))))
    each = each.join(given, [by, "layout", *left, *right, "turn"], "left").join(own, [by, "layout", *left]).join(mass, [by, "layout", *left], "left")
    support, mean = F.col("n") + F.coalesce("given", F.lit(0)), (F.col("own") + F.coalesce("around", F.lit(0))) / 9.0
    standing = each.filter(support > factor * F.sqrt(mean)).select(by, "layout", *left, *right, "turn")
    kept = laid.join(standing, [by, "layout", *left, *right]).select(by, "i", "turn").distinct()
    best = kept.groupBy(by, "turn").agg(F.count("*").alias("k")).groupBy(by).agg(F.min(F.struct(-F.col("k"), F.col("turn"))).alias("b")).select(by, F.col("b.turn").alias("turn"))
    return m.join(kept.join(best, [by, "turn"]).select(by, "i"), [by, "i"], "left_semi")


def one_way(left: DataFrame, right: DataFrame, by: str, limit: float, most: int, size: tuple[float, float], grid: int, factor: float) -> DataFrame:
    """(by, i, j) of the left keypoints' matches that pass quality, number, votes and uniqueness.

    Quality is d0 * d0 / d1 below ``limit``; the ``most`` best of a pair go on to the votes (see
    ``voted``). Of matches that share a place (to a hundredth) on either side, the best stays, then
    the first by id.
    """
    near = two_nearest(left, right, by)
    best = near.groupBy(by, "i").agg(F.min(F.when(F.col("rn") == 1, F.col("j"))).alias("j"), F.min(F.when(F.col("rn") == 1, F.col("d"))).alias("d0"), F.min(F.when(F.col("rn") == 2, F.col("d"))).alias("d1"))
    m = best.withColumn("metric", F.round(F.col("d0") * F.col("d0") / F.nullif("d1", F.lit(0.0)), 9)).filter(F.col("metric") < limit)
    order = ["metric", "i"]
    m = m.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("k") <= most)
    m = m.join(left.select(by, F.col("id").alias("i"), F.col("u").alias("u1"), F.col("v").alias("v1")), [by, "i"])
    m = m.join(right.select(by, F.col("id").alias("j"), F.col("u").alias("u2"), F.col("v").alias("v2")), [by, "j"])
    m = voted(settled(m), by, size, grid, factor)
    # both places at once: a match goes if a better one has either of its places
    first = [F.row_number().over(Window.partitionBy(by, *(F.floor(F.col(c + s) * 100 + 0.5) for c in "uv")).orderBy(*order)) for s in "12"]
    return m.withColumns({"f1": first[0], "f2": first[1]}).filter("f1 = 1 and f2 = 1").select(by, "i", "j")


def match_pairs(left: DataFrame, right: DataFrame, by: str, *, limit: float, size: tuple[float, float], most: int = 2000, grid: int = 20, factor: float = 5.0, least: int = 25) -> DataFrame:
    """(by, i, j): matches of the two images of each pair that hold both ways, where there are ``least`` of them each way.

    left and right: (by, id, vec, u, v), the keypoints of the pair's images, which are of ``size``.
    """
    ahead, back = one_way(left, right, by, limit, most, size, grid, factor), one_way(right, left, by, limit, most, size, grid, factor)
    enough = lambda m: m.join(m.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(by), by, "left_semi")
    return enough(ahead).join(enough(back).select(by, F.col("j").alias("i"), F.col("i").alias("j")), [by, "i", "j"], "left_semi")

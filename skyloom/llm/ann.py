"""Nearest neighbours over randomly rotated one-bit codes.

Index: a unit vector minus the centre is rotated by a seeded random orthogonal matrix; the signs
are packed into bits, with two scalars a row: the length of the difference, and the inner product
of the code with the direction it stands for. Search: the code's inner product with the rotated
query, divided by that scalar, estimates the true one within a known error at high probability.
Rows whose upper bound reaches the k-th best score so far are scored exactly on the original
vectors; the others are passed over. Tiles of the index and blocks of queries meet on the
executors, one plan for any number of queries: a cell holds one of each, and leaves the best k.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Width of the error bound in standard deviations.
WIDTH = 3.0
#: Rows that the centre is fitted on at most, bytes of vectors in a tile or a block, and queries that are searched at once.
CENTRE_ROWS, CELL_BYTES, QUERY_STEP = 20_000, 32 << 20, 2048
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int | None) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part: not null or zero, of finite components and of ``dim`` of them."""
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull())
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    if dim is None:
        most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = most["n"] if most else 1
    return rows.filter(F.size("v") == dim), dim


def unit(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal bits wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(rows: DataFrame, dim: int, seed: int = SEED, centre_rows: int = CENTRE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Every row's code, written to the shared folder: id, v, bits, length, along, fit; and the centre.

    The centre is the mean unit vector of at most ``centre_rows`` rows (those with the smallest
    hashes of their ids); it moves the size of the errors, never their bounds.
    """
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(centre_rows).select("v").toPandas()["v"]
    centre = unit(np.array(sample.tolist())).mean(axis=0) if len(sample) else np.zeros(dim)
    turn = rotation(dim, seed)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            o = unit(matrix(batch.column(1), dim))
            off = o - centre
            length = np.sqrt((off * off).sum(axis=1))
            turned = (off @ turn) / np.maximum(length, 1e-300)[:, None]
            bits = turned > 0
            fit = np.where(bits, turned, -turned).sum(axis=1) / math.sqrt(dim)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(length), pa.array(o @ centre), pa.array(fit)],
                ["id", "v", "bits", "length", "along", "fit"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    index = written(rows.mapInArrow(encode, f"id {kind}, v array<double>, bits binary, length double, along double, fit double"), "ann-index")
    return index, centre


class Search:
    """Searches batches of the index for one block of queries and keeps the best k of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, width: float):
        self.ids, self.vectors, self.k = ids, vectors, k
        q = unit(vectors)
        self.along = q @ centre
        off = q - centre
        self.turned = off @ turn
        self.length = np.sqrt((off * off).sum(axis=1))
        self.centre2 = float(centre @ centre)
        self.dim = vectors.shape[1]
        self.width = width / math.sqrt(max(1, self.dim - 1))
        n = len(ids)
        self.best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=ids.dtype), np.zeros(0))
        self.worst = np.full(n, -np.inf)
        self.scored = 0

    def batch(self, ids, vectors, bits, length, along, fit) -> None:
        signs = np.unpackbits(bits, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        fit = np.maximum(fit, 1e-9)
        raw = (signs @ self.turned.T.astype(np.float32)) / math.sqrt(self.dim)
        estimate = raw * (length / fit)[:, None] + along[:, None] + self.along[None, :] - self.centre2
        error = (length * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit)[:, None] * (self.length * self.width)[None, :] + 1e-6
        upper, lower = estimate + error, estimate - error
        # one more than k, as the query itself may be among the rows
        if len(ids) > self.k:
            floor = np.partition(lower, len(ids) - self.k - 1, axis=0)[len(ids) - self.k - 1]
            floor = np.maximum(floor, self.worst)
        else:
            floor = self.worst
        row, query = np.nonzero(upper >= floor[None, :] - 1e-9)
        other = ids[row] != self.ids[query]
        row, query = row[other], query[other]
        self.scored += len(row)
        scores = np.concatenate([cosine(vectors[row[a : a + 65536]], self.vectors[query[a : a + 65536]]) for a in range(0, len(row), 65536)] or [np.zeros(0)])
        q, c, s = (np.concatenate(x) for x in zip(self.best, (query, ids[row], scores)))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        self.best = q, c, s = q[keep], c[keep], s[keep]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        full = rank == self.k - 1
        self.worst[q[full]] = s[full]


def nearest(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 5, dim: int | None = None,
    width: float = WIDTH, seed: int = SEED, query_block: int | None = None, tile_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k nearest rows of ``df`` for each row of ``queries``, by cosine.

    A row is never its own query's neighbour. Ties go to the smaller id. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do rows with a null id or with
    another number of components than ``dim`` (default: the most frequent one). Repeated rows
    are candidates of their own; queries that share an id are one, the smallest of their vectors. Tiles of ``tile_rows`` rows and blocks of ``query_block`` queries
    (default: CELL_BYTES of vectors each) meet as cells, so a row is sent once for each block and a
    query once for each tile. Empty tables give an empty result.
    """
    spark = df.sparkSession
    rows, dim = usable(df, id_col, vec_col, dim)
    asked, _ = usable(queries, id_col, vec_col, dim)
    index, centre = build_index(rows, dim, seed)
    asked = written(asked.groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    n, m, fits = index.count(), asked.count(), max(1, CELL_BYTES // (8 * dim))
    # small tables are cut further, so that all cores have a tile
    tiles = max(1, math.ceil(n / (tile_rows or fits)), min(spark.sparkContext.defaultParallelism, n // 1024))
    blocks = max(1, math.ceil(m / (query_block or fits)))
    turn, kind = rotation(dim, seed), rows.schema["id"].dataType.simpleString()
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    tiled = index.withColumn("tile", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(tiles)).cast("int")).withColumn("block", each(blocks))
    cut = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("tile", each(tiles))

    def cell(index, queries):
        import pyarrow as pa

        index, queries = index.combine_chunks(), queries.combine_chunks()
        out = []
        if index.num_rows and queries.num_rows:
            asked_ids, vectors = queries.column("id").to_numpy(), matrix(queries.column("v").combine_chunks(), dim)
            bits = np.frombuffer(b"".join(index.column("bits").to_pylist()), dtype=np.uint8).reshape(index.num_rows, -1)
            ids, all_ = index.column("id").to_numpy(), matrix(index.column("v").combine_chunks(), dim)
            scalars = [index.column(c).to_numpy() for c in ("length", "along", "fit")]
            for a in range(0, len(asked_ids), QUERY_STEP):
                s = Search(asked_ids[a : a + QUERY_STEP], vectors[a : a + QUERY_STEP], centre, turn, k, width)
                step = max(256, 4_000_000 // len(s.ids))
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    s.batch(ids[part], all_[part], bits[part], *(x[part] for x in scalars))
                q, c, score = s.best
                out.append((s.ids[q], c, score))
        types = [index.schema.field("id").type] * 2 + [pa.float64()]
        columns = [pa.array(np.concatenate(x), type=t) for x, t in zip(zip(*out), types)] or [pa.nulls(0, t) for t in types]
        return pa.table(columns, ["query_id", "id", "score"])

    keys = ["tile", "block"]
    found = tiled.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInArrow(cell, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

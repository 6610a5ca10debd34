"""Chains of matches, connected components and image groups."""

from __future__ import annotations

import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(df: DataFrame) -> str:
    """The session's shared folder; a temporary one only in a local session where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's shared folder."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as Parquet to the shared folder and read again, and what deletes it there: for states that the next round replaces."""
    spark, path = df.sparkSession, f"{shared_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as leave about ``rows`` rows in each, however much there is; they are not merged again."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) with the smallest id reachable from each id of the undirected edges.

    Rounds of the smallest neighbouring label followed by a jump to the label's own label; the
    number of rounds grows with the logarithm of the longest path.
    """
    both = settled(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(b, a)).distinct())
    now = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("id"), "c"))
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = now.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        own = now.select(F.col("id").alias("c"), F.col("c").alias("j"))
        new = settled(low.join(own, "c").select("id", "was", F.least("c", "j").alias("c")))
        if not new.filter("c <> was").limit(1).count():
            return new.select("id", F.col("c").alias("component"))
        now = new.select("id", "c")


def direct_chains(pairs: DataFrame) -> DataFrame:
    """Pairs with image_i < image_j, each a chain of two observations; the reverse direction is the same pair."""
    return pairs.filter("image_i < image_j")


def replay(pairs: list[tuple[int, int, int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(seed index, observations) of the chains that sequential linking makes of pairs (image, keypoint, image, keypoint).

    In order, a chain joins the chain that its first known observation belongs to and brings its
    observations of images that chain lacks; otherwise it stands for itself. Passes repeat until
    their number of chains stays.
    """
    chains = [(k, [(i, p), (j, q)]) for k, (i, p, j, q) in enumerate(pairs)]
    while True:
        home: dict[tuple[int, int], int] = {}
        out: list[tuple[int, dict[int, int]]] = []
        for seed, members in chains:
            at = next((home[o] for o in members if o in home), None)
            if at is None:
                at = len(out)
                out.append((seed, list(members)))
                home.update((o, at) for o in members)
                continue
            images = {i for i, _ in out[at][1]}
            for o in members:
                if o[0] not in images:
                    images.add(o[0])
                    out[at][1].append(o)
                    home[o] = at
        if len(out) == len(chains):
            return out
        chains = out


def link_chains(pairs: DataFrame) -> DataFrame:
    """(chain, pos, image, kp) of ordered pairs (ord, image_i, kp_i, image_j, kp_j).

    Chains never leave the connected component of the keypoints, so components come first and
    each one is replayed alone, in the pairs' order: the result is that of one global loop.
    A chain's id is the ord of its first pair.
    """
    width = 1 << 32
    key = pairs.withColumns({"a": F.col("image_i").cast("long") * width + F.col("kp_i"), "b": F.col("image_j").cast("long") * width + F.col("kp_j")})
    comp = components(key, "a", "b").withColumnRenamed("id", "a")
    rows = key.join(comp, "a").select("component", "ord", "image_i", "kp_i", "image_j", "kp_j")

    def run(g):
        import pandas as pd

        g = g.sort_values("ord", kind="stable")
        ords = g["ord"].tolist()
        chains = replay(list(zip(*(g[c].tolist() for c in ("image_i", "kp_i", "image_j", "kp_j")))))
        return pd.DataFrame([(ords[s], p, i, k) for s, members in chains for p, (i, k) in enumerate(members)], columns=["chain", "pos", "image", "kp"])

    return rows.groupBy("component").applyInPandas(run, "chain long, pos int, image long, kp long")


def parts(obs: DataFrame) -> DataFrame:
    """(image, part): the smallest image that each image of (chain, image) is tied to through chains."""
    first = F.min("image").over(Window.partitionBy("chain"))
    return components(obs.select(F.col("image").cast("long").alias("a"), first.cast("long").alias("b"))).select(F.col("id").alias("image"), F.col("component").alias("part"))


def runs(batches, *keys: str) -> Iterator[tuple[bool, tuple, dict[str, np.ndarray]]]:
    """Sorted batches cut where a key changes: (whether a new run begins, the keys, columns)."""
    last = None
    for batch in batches:
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        change = [np.flatnonzero(cols[k][1:] != cols[k][:-1]) + 1 for k in keys]
        cuts = np.unique(np.concatenate([[0, batch.num_rows], *change])).astype(int)
        for at, stop in zip(cuts, cuts[1:]):
            key = tuple(cols[k][at] for k in keys)
            yield key != last, key, {c: x[at:stop] for c, x in cols.items()}
            last = key


class Listed:
    """Numbers appended to an unlinked temporary file of the task and read as one mapped array: their pages are the system's to keep or drop."""

    def __init__(self, kind: str):
        self.kind, self.file, self.n = np.dtype(kind), tempfile.TemporaryFile(), 0

    def add(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, dtype=self.kind).data)
        self.n += len(values)

    def mapped(self, n: int | None = None) -> np.ndarray:
        """What was added; or ``n`` numbers to be written."""
        self.file.flush()
        if n is not None:
            self.file.truncate(n * self.kind.itemsize)
            self.n = n
        return np.asarray(np.memmap(self.file, dtype=self.kind, mode="r+", shape=(self.n,))) if self.n else np.zeros(0, self.kind)


def chains_of_images(starts: np.ndarray, flat: np.ndarray, images: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(begins, chains): image i is in chains[begins[i]:begins[i + 1]], ascending; ``step`` observations, or as many as there are images, are turned at a time."""
    step = max(step, images)
    places = range(0, len(flat), step)
    counts = np.zeros(images, dtype=np.int64)
    for at in places:
        counts += np.bincount(flat[at : at + step], minlength=images)
    begins = np.r_[0, np.cumsum(counts)]
    free, chains = begins[:-1].copy(), Listed("int32").mapped(len(flat))
    for at in places:
        some = flat[at : at + step]
        low, high = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(some))
        owner = np.repeat(np.arange(low, high, dtype=np.int32), np.diff(np.clip(starts[low : high + 1], at, at + len(some))))
        order, n = np.argsort(some, kind="stable"), np.bincount(some, minlength=images)
        chains[np.repeat(free - (np.cumsum(n) - n), n) + np.arange(len(some))] = owner[order]
        free += n
    return begins, chains


def grown(starts: np.ndarray, flat: np.ndarray, images: int, wanted: int, least: int, smallest: int, min_chain: int, level: array | None = None) -> Iterator[tuple[int, list[int]]]:
    """(seed chain, images) of the groups of ``grow_groups`` in turn, also of those that are too small; chain k is flat[starts[k]:starts[k + 1]].

    A chain is asked once in a group, when the sweep comes by after it was tied: it stays tied, and images
    that are full stay full, so a chain that was refused is refused again. An image of the group is placed, so it ties its
    chains in one group only: the work grows with the observations, whatever the number of groups and sweeps.
    In memory are four bytes a chain and some for each image. Chain k's level goes to ``level``, if that is given.
    """
    ties_needed, firm, sizes, kept = 1 if min_chain == 2 else 2, min(least, wanted), np.diff(starts), 0
    begins, chains = chains_of_images(starts, flat, images)
    shut, asked, ties = sizes < (1 if min_chain == 2 else 3), np.zeros(len(sizes), dtype=bool), np.zeros(len(sizes), dtype=np.int8)
    have, placed, queue = array("i", bytes(4 * images)), bytearray(images), bytearray(len(sizes))
    queued = np.frombuffer(queue, dtype=np.uint8)
    members = lambda k: flat[starts[k] : starts[k + 1]].tolist()
    holding = lambda i: chains[begins[i] : begins[i + 1]]

    def ask(some: np.ndarray) -> None:
        some = some[~(shut[some] | asked[some])]
        asked[some], queued[some] = True, 1

    def take(k: int) -> None:
        shut[k] = True
        if level is not None:
            level[k] = kept
        for i in members(k):
            have[i] = n = have[i] + 1
            if n == 1:
                seen.append(i)
            if n == firm and not placed[i]:
                mine = holding(i)
                ties[mine] = np.minimum(ties[mine] + 1, ties_needed)
                ties[mine[1:][mine[1:] == mine[:-1]]] = ties_needed  # chains that hold the image twice
                ask(mine[ties[mine] == ties_needed])

    # chains come longest first and none that was taken or touches a placed image is free again
    for seed in range(int((sizes > 2).sum())):
        if shut[seed]:
            continue
        first = members(seed)
        if any(placed[i] for i in first):
            continue
        seen, start = array("i"), first[1]
        take(seed)
        ask(holding(start))
        k = queue.find(1)
        while k >= 0:
            queue[k] = 0
            if any(have[i] < wanted and not placed[i] for i in members(k)):
                take(k)
            k = queue.find(1, k + 1)
            if k < 0:  # the next sweep
                k = queue.find(1)
        mine = sorted(i for i in seen if have[i] >= least)
        asked[holding(start)] = False
        for i in seen:
            if have[i] >= firm and not placed[i]:
                asked[holding(i)], ties[holding(i)] = False, 0
            have[i] = 0
        for i in mine:
            placed[i] = 1
        kept += len(mine) >= smallest
        yield seed, mine
        if len(mine) < 3:
            return


def most_wanted(images: int) -> int:
    """Features of an image from which on it wants no more."""
    return max(200, int(8000 / max(1, images) ** 0.5))


def grow_groups(chains: list[list[int]], images: int, least: int = 25, smallest: int = 7, min_chain: int = 3) -> tuple[list[list[int]], list[int]]:
    """Groups of images, and the level of each chain (-1: none), by saturating growth; chains come longest first.

    A group starts with the first chain that touches most unplaced images (three or more) and no
    placed one. Sweeps over the free chains add one when it is tied to the group - it holds the
    seed image, or more than one image that has ``least`` features - and some image of it still
    wants features. Images with ``least`` features are the group's. Groups below ``smallest``
    go, yet their images stay placed; below three images the search ends.
    """
    starts, flat = np.cumsum([0, *map(len, chains)]), np.array([i for c in chains for i in c], dtype=np.int32)
    level = array("i", [-1]) * len(chains)
    groups = [mine for _, mine in grown(starts, flat, images, most_wanted(images), least, smallest, min_chain, level) if len(mine) >= smallest]
    return groups, level.tolist()


def image_groups(obs: DataFrame, images: int, least: int = 25, smallest: int = 7) -> DataFrame:
    """(group_id, image) of observations (chain, pos, image); ``images`` is the number of images.

    The growth depends on the order of all chains of a part, images that chains tie together, so a task
    replays a part. Chains are made where they are, each one row of places of its images in the part; those of
    fewer than three images neither begin a group nor join one and stay out. The task keeps them in mapped files (8 bytes an
    observation) and not in memory. Parts do not touch each other, and groups begin in the order of their seed chains whatever
    the part; so the groups of all parts in that order, as far as the first of fewer than three images, are those of one growth.
    """
    from .ranks import ranked

    size = F.count("*").over(Window.partitionBy("chain"))
    obs, drop = stored(obs.select(F.col("chain").cast("long").alias("chain"), "pos", F.col("image").cast("long").alias("image")).withColumn("size", size).filter("size > 2"))
    wanted = most_wanted(images)
    place = ranked(parts(obs), ["part", "image"], "rank")
    place = place.join(place.groupBy("part").agg(F.min("rank").alias("first")), "part")
    place = settled(place.select("part", "image", (F.col("rank") - F.col("first")).cast("int").alias("at")))
    rows = obs.join(place, "image").groupBy("part", "size", "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("o"))
    rows = rows.select("part", (-F.col("size")).alias("size"), "chain", F.col("o.at").alias("images"))

    def run(batches):
        import pyarrow as pa

        def grow():
            heads, names = lists["starts"].mapped(), lists["chains"].mapped()
            flat = lists["images"].mapped()
            for seed, mine in grown(heads, flat, int(flat.max()) + 1, wanted, least, smallest, 3):
                columns = [[part], [int(heads[seed] - heads[seed + 1])], [int(names[seed])], [mine]]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["part", "size", "chain", "members"])

        part = None
        for batch in batches:
            key, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "chain"))
            offsets, values = (x.to_numpy(zero_copy_only=False) for x in (batch.column("images").offsets, batch.column("images").flatten()))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(cuts, cuts[1:]):
                if high == low:
                    continue
                if key[low] != part:
                    if part is not None:
                        yield from grow()
                    part, lists = int(key[low]), {"starts": Listed("int64"), "chains": Listed("int64"), "images": Listed("int32")}
                    lists["starts"].add(np.zeros(1))
                some = offsets[low : high + 1].astype(np.int64) - offsets[0]
                lists["starts"].add(some[1:] - some[0] + lists["images"].n)
                lists["chains"].add(at[low:high])
                lists["images"].add(values[some[0] : some[-1]])
        if part is not None:
            yield from grow()

    tasks = max(obs.sparkSession.sparkContext.defaultParallelism, -(-obs.count() // 4_000_000))
    rows = rows.repartition(tasks, "part").sortWithinPartitions("part", "size", "chain")
    found = settled(rows.mapInArrow(run, "part long, size long, chain long, members array<int>"))
    drop()
    last = found.filter(F.size("members") < 3).agg(F.min(F.struct("size", "chain")).alias("k")).first()["k"]
    kept = found.filter(F.size("members") >= smallest)
    if last is not None:
        kept = kept.filter((F.col("size") < last["size"]) | (F.col("size") == last["size"]) & (F.col("chain") < last["chain"]))
    at = ranked(kept, ["size", "chain"], "rank").select((F.col("rank") - 1).cast("int").alias("group_id"), "part", F.explode("members").alias("at"))
    return at.join(place, ["part", "at"]).select("group_id", "image")

"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

The lines are hashed once. Keys that very many lines share (a bounded number of keys) are told by
counts that are combined before the shuffle, and their lines never meet in one task: they get their
owners by a broadcast join. The hashes of all other lines are shuffled once, into a table bucketed
by the 128-bit hash of the line's key. A run is a table of (h1, h2, owner) with the same buckets, one sorted file a bucket. A new
batch of lines is reduced to one row a key inside its buckets, merge-anti-joined with each run so
that only keys seen for the first time are left, and those are added as a run of level 0. When a
level holds ``fanout`` runs they are merged, bucket by bucket, into one run of the next level, so a
batch is joined with at most ``(fanout - 1) * levels`` runs. Neither the lines nor a run are
shuffled again, and sorted files are not sorted again for a join.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .shared import ASCII_SPACE, discard, fold_ascii, free_name, scratch, written

MIN_POINTS = 10
#: Bytes of text behind one batch of lines, and the batches that are made at least.
BATCH_BYTES, MIN_BATCHES = 1 << 40, 4
FANOUT = 2
#: A key is hot above this many lines, or above the HOT_KEYS-th part of all: at most HOT_KEYS keys (3 MB) are sent to the executors.
HOT_LINES, HOT_KEYS = 1000, 100_000
KEY = ["h1", "h2"]


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Plans made inside take the order of bucket files as given, where a bucket is one file."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Tables:
    """Bucketed tables in the shared folder, dropped with their files."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def write(self, rows: DataFrame, kind: str) -> str:
        """``rows``, which are dealt by the key, as a table of one sorted file a bucket."""
        name = f"line_{kind}_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, f"line-{kind}")
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *KEY)

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, self.paths.pop(name))


class LineRuns:
    """The levelled runs. ``levels[k]`` lists the table names of level k, oldest first."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables = Tables(spark, self.buckets)
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def seen(self) -> DataFrame | None:
        """All (h1, h2, owner) so far, each key once; None before the first batch."""
        out = None
        for t in self.runs():
            out = self.spark.table(t) if out is None else out.unionAll(self.spark.table(t))
        return out

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """The keys of ``firsts`` that no run holds: a merge anti-join with each run."""
        for t in self.runs():
            firsts = firsts.join(self.spark.table(t).select(*KEY).hint("merge"), KEY, "left_anti")
        return firsts

    def lost(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (id, h1, h2, ...) whose key another id owns: one merge join a run, the owner compared after it."""
        own = lines.columns
        owner = F.lit(None)
        for k, t in enumerate(self.runs()):
            lines = lines.join(self.spark.table(t).withColumnRenamed("owner", f"owner_{k}").hint("merge"), KEY, "left")
            owner = F.coalesce(owner, F.col(f"owner_{k}"))
        return lines.filter(owner != F.col("id")).select(*own)

    def add(self, firsts: DataFrame) -> str:
        """Adds the keys of ``firsts`` (h1, h2, owner; one row a key, dealt by the key) that no run holds."""
        with sorted_buckets(self.spark):
            name = self.tables.write(self.unseen(firsts), "run")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._compact()
        return name

    def merged(self, names: list[str]) -> DataFrame:
        """Runs as one: merge joins of disjoint keys, bucket by bucket."""
        out = self.spark.table(names[0])
        for t in names[1:]:
            more = self.spark.table(t).withColumnRenamed("owner", "more").hint("merge")
            out = out.join(more, KEY, "full").select(*KEY, F.coalesce("owner", "more").alias("owner"))
        return out

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                old = self.levels[k]
                with sorted_buckets(self.spark):
                    merged = self.tables.write(self.merged(old), "run")
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                self.tables.drop(old)
            k += 1

    def drop(self) -> None:
        """Drops all runs and their files."""
        self.tables.drop(self.runs())
        self.levels = []


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """(id, t, pos, h1, h2) of every line whose key has ``min_points`` code points or more.

    t is the hash of the whole text: rows that share an id but not a text stay apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = fold_ascii(F.btrim(F.col("line"), F.lit(ASCII_SPACE)))
    return (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("id", "t", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_points)
        .select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )


def hot_keys(lines: DataFrame) -> DataFrame:
    """(h1, h2, owner) of the keys that more than HOT_LINES lines and more than one of HOT_KEYS of all have; at most HOT_KEYS rows."""
    least = max(HOT_LINES, lines.count() // HOT_KEYS)
    counts = lines.groupBy(*KEY).agg(F.min("id").alias("owner"), F.count("*").alias("n"))
    return written(counts.filter(F.col("n") > least).drop("n"), "hot-lines")


def batch_edges(docs: DataFrame, id_col: str, text_col: str, batches: int | None) -> list:
    """Ids that cut the table into about equal batches of ascending ids; one batch where ids are not numeric."""
    if not isinstance(docs.schema[id_col].dataType, NumericType):
        return []
    if batches is None:
        total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        batches = max(MIN_BATCHES, math.ceil(total / BATCH_BYTES))
    if batches < 2:
        return []
    at = [k / batches for k in range(1, batches)]
    got = docs.agg(F.percentile_approx(id_col, at, 1000).alias("q")).first()["q"]
    return sorted(set(got or []))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_points: int = MIN_POINTS,
    batches: int | None = None, fanout: int = FANOUT, runs: LineRuns | None = None,
) -> DataFrame:
    """``docs`` with the columns ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines end at \\n; a null or empty text is one empty line. A line's key is the line without
    ASCII white space at both ends and with A-Z lower-cased. A key of ``min_points`` code points
    or more keeps its lines (also repeats) in the smallest id that holds it and loses them in all
    other ids. Shorter lines stay. Batches are ascending ranges of numeric ids (default: one for
    each BATCH_BYTES of text, MIN_BATCHES at least; ids of other types make one batch), so the
    first run that holds a key has its smallest owner. With ``runs`` (from earlier calls on
    smaller ids) the keys of earlier batches count as well, and the new ones are added; without,
    the runs are dropped at the end. Only the positions of lost lines are written.

    Rows with a null id are kept whole and own no key. Repeated rows share their id's fate, so
    each of them keeps the lines that the id owns. Columns called kept_text, n_lines or n_dropped
    are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own_runs = runs is None
    runs = LineRuns(spark, fanout=fanout) if own_runs else runs
    edges = batch_edges(docs, id_col, text_col, batches)
    tables = Tables(spark, runs.buckets)
    lines = written(line_hashes(docs, id_col, text_col, min_points), "line-hashes")
    hot = hot_keys(lines)
    name = tables.write(tables.dealt(lines.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti")), "lines")
    if hot.limit(1).count():
        runs.add(tables.dealt(hot))
    for lo, hi in zip([None, *edges], [*edges, None]):
        batch = spark.table(name)
        if lo is not None:
            batch = batch.filter(F.col("id") > F.lit(lo))
        if hi is not None:
            batch = batch.filter(F.col("id") <= F.lit(hi))
        runs.add(batch.groupBy(*KEY).agg(F.min("id").alias("owner")))
    owners = runs.seen().join(F.broadcast(hot.select(*KEY)), KEY, "left_semi")
    from_hot = lines.join(F.broadcast(owners), KEY).filter(F.col("owner") != F.col("id")).select("id", "t", "pos")
    with sorted_buckets(spark):
        lost = runs.lost(spark.table(name)).select("id", "t", "pos").unionAll(from_hot)
        lost = written(lost.groupBy("id", "t").agg(F.collect_list("pos").alias("lost")), "lost-lines")
    tables.drop([name])
    if own_runs:
        runs.drop()
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    whole, lines, gone = (free_name(docs, x) for x in ("whole", "lines", "gone"))
    d = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias(whole)).alias("d")
    same = (F.col(f"d.{id_col}") == F.col("g.id")) & (F.xxhash64(F.col(f"d.{whole}")) == F.col("g.t"))
    joined = d.join(lost.alias("g").hint("shuffle_hash"), same, "left").select(
        "d.*",
        F.split(F.col(f"d.{whole}"), "\n").alias(lines),
        F.array_distinct(F.coalesce(F.col("g.lost"), F.array().cast("array<int>"))).alias(gone),
    )
    # array_except is one pass with a hash set, in the order of the positions: linear for texts of any length
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda p: F.element_at(F.col(lines), p + 1)), "\n")
    return joined.select(
        *own,
        F.when(F.size(gone) == 0, F.col(whole)).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )

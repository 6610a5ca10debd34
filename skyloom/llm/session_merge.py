"""Late session merging: the versions of each user's sessions while batches of late events arrive.

Events come in batches that need not follow their own time. After each batch, neighbours in time at
most ``gap`` apart share a session; a session that holds an event of the batch is a new version and
retracts the standing sessions that it contains. All of it stays on the JVM: sorted batch structs
are collected and folded with higher-order functions over an array of standing sessions, and the
log of versions is exploded.

What is folded is not a whole user but an island, a stretch of a user's events without a pause
above ``gap`` when all batches are in: no session of any batch reaches beyond one, so islands are
independent. They are found without a task for a user: slots of six hours are looked at alone, and a
slot whose first piece goes on from the slot before takes that one's label, by pointer doubling
where pieces fill whole slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Seconds of a slot; it bounds the rows that meet in one window, not the length of a session.
SLOT = 21_600
VERSION = "batch bigint, start_s bigint, end_s bigint, n_events bigint, n_new bigint, n_retracted bigint, h_sum bigint, retracted_batch bigint, retracted_start_s bigint"
#: A session of a merge: its span, counts, sum, events of this batch, and the standing versions in it.
ITEM = f"start_s bigint, end_s bigint, n_events bigint, h_sum bigint, n_new bigint, olds array<struct<{VERSION}>>"


def last(a: Column) -> Column:
    """The last element, null where there is none."""
    return F.get(a, F.size(a) - 1)


def item(start, end, n, h, new, olds) -> Column:
    fields = zip(("start_s", "end_s", "n_events", "h_sum", "n_new", "olds"), (start, end, n, h, new, olds))
    return F.struct(*(c.alias(name) for name, c in fields)).cast(f"struct<{ITEM}>")


def joined(a: Column, b: Column) -> Column:
    """Two items as one; ``a`` starts first."""
    return item(a.start_s, F.greatest(a.end_s, b.end_s), a.n_events + b.n_events, a.h_sum + b.h_sum, a.n_new + b.n_new, F.concat(a.olds, b.olds))


def merged(items: Column, gap: int) -> Column:
    """Items in order of their starts, those at most ``gap`` apart made one."""

    def step(done: Column, x: Column) -> Column:
        near = F.coalesce(x.start_s - last(done).end_s <= gap, F.lit(False))
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last(done), x)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(items), F.array().cast(f"array<struct<{ITEM}>>"), step)


def version(batch: Column, x: Column) -> Column:
    none = F.lit(None).cast("long")
    values = (batch, x.start_s, x.end_s, x.n_events, x.n_new, F.size(x.olds).cast("long"), x.h_sum, none, none)
    return F.struct(*(c.alias(f.split()[0]) for c, f in zip(values, VERSION.split(", "))))


def standing(at: Column) -> Column:
    """Versions that stand after a batch: the new ones, and those that it left alone."""
    return F.transform(at["items"], lambda x: F.when(x.n_new > 0, version(at.batch, x)).otherwise(F.get(x.olds, 0)))


def closed(at: Column) -> Column:
    """Versions that a batch retracted, each with the version that did."""
    new = F.filter(at["items"], lambda x: x.n_new > 0)
    return F.flatten(F.transform(new, lambda x: F.transform(x.olds, lambda o: o.withField("retracted_batch", at.batch).withField("retracted_start_s", x.start_s))))


def fold(batches: Column, gap: int) -> Column:
    """The log of versions of sorted (batch, items of that batch alone)."""
    none = F.array().cast(f"array<struct<{VERSION}>>")
    begin = F.struct(F.lit(None).cast("long").alias("batch"), F.array().cast(f"array<struct<{ITEM}>>").alias("items"), none.alias("log"))

    def step(at: Column, b: Column) -> Column:
        left = F.transform(standing(at), lambda v: item(v.start_s, v.end_s, v.n_events, v.h_sum, F.lit(0), F.array(v)))
        return F.struct(b.batch.alias("batch"), merged(F.concat(left, b["items"]), gap).alias("items"), F.concat(at.log, closed(at)).alias("log"))

    return F.aggregate(batches, begin, step, lambda at: F.concat(at.log, closed(at), standing(at)))


def islands(points: DataFrame, gap: int, slot: int = SLOT) -> DataFrame:
    """Points (user, s, ...) with the start of their island, the stretch without a pause above ``gap``."""
    slot = max(slot, gap)
    within = Window.partitionBy("user", "slot").orderBy("s")
    pause = F.col("s") - F.lag("s").over(within)
    points = points.withColumn("slot", F.col("s") - F.pmod("s", F.lit(slot)))
    pieces = points.withColumn("fresh", F.when(pause.isNull() | (pause > gap), F.col("s")))
    pieces = pieces.withColumn("start", F.max("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")
    pieces = written(pieces, "session-pieces")
    ends = pieces.groupBy("user", "slot").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max("start").alias("tail"))
    before = ends.select("user", (F.col("slot") + slot).alias("slot"), "high", F.col("tail").alias("label"), F.when(F.col("tail") == F.col("low"), F.col("slot")).alias("to"))
    # slots that go on from the one before; "to" is a slot of one piece, which may go on itself
    links = ends.drop("high", "tail").join(before.hint("merge"), ["user", "slot"]).filter(F.col("low") - F.col("high") <= gap)
    links = written(links.select("user", "slot", "low", "label", "to"), "session-links")
    while not links.filter("to is not null").isEmpty():
        up = links.select("user", F.col("slot").alias("to"), F.col("label").alias("up_label"), F.col("to").alias("up_to"))
        far = links.join(up.hint("merge"), ["user", "to"], "left")
        links = written(far.select("user", "slot", "low", F.coalesce("up_label", "label").alias("label"), F.col("up_to").alias("to")), "session-links")
    heads = links.select("user", "slot", F.col("low").alias("start"), "label")
    out = pieces.join(heads.hint("merge"), ["user", "slot", "start"], "left")
    return out.withColumn("island", F.coalesce("label", "start")).drop("slot", "start", "label")


def session_versions(
    events: DataFrame, user_col: str = "user", time_col: str = "seconds", batch_col: str = "batch", sum_col: str | None = "h", *, gap: int = 240, slot: int = SLOT,
) -> DataFrame:
    """(user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum, retracted_batch, retracted_start_s): every version of every session.

    ``retracted_batch`` and ``retracted_start_s`` name the version that retracted a row; they are
    null where it stands at the end. Times and batches are whole numbers, negative ones too. Events
    with a null user, time or batch take no part; a null value adds nothing to ``h_sum``. Repeated
    events count each; those of one user, second and batch are summed before anything is sorted, so
    an island's array grows with its seconds, not its rows. Other columns are not read. Empty tables
    give an empty result.
    """
    value = F.coalesce(F.col(sum_col).cast("long"), F.lit(0)) if sum_col else F.lit(0)
    rows = events.select(F.col(user_col).alias("user"), F.col(time_col).cast("long").alias("s"), F.col(batch_col).cast("long").alias("batch"), value.alias("h")).dropna(subset=["user", "s", "batch"])
    points = rows.groupBy("user", "s", "batch").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    own = F.transform(F.collect_list(F.struct("s", "n", "h")), lambda p: item(p.s, p.s, p.n, p.h, p.n, F.array()))
    batches = islands(points, gap, slot).groupBy("user", "island", "batch").agg(merged(own, gap).alias("items"))
    folded = batches.groupBy("user", "island").agg(fold(F.sort_array(F.collect_list(F.struct("batch", "items"))), gap).alias("log"))
    return folded.select("user", F.explode("log").alias("v")).select("user", "v.*")

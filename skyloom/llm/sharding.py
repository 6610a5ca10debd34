"""Two-pass external shuffle into shards. DataFrame functions only.

Pass 1 scatters the records uniformly into buckets of about ``bucket_bytes`` with a seeded
hash. Pass 2 puts each bucket, which fits in memory, into a random order with a Fisher-Yates
shuffle (Spark's ``shuffle`` of an array) and writes it. The written buckets in order are one
random permutation of the input; its records are dealt to the shards in turn, so shard sizes
differ by one row at most (law ``rows``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_name, written

BUCKET_BYTES = 8 << 20
MIN_BUCKETS = 64
#: Buckets at most, above which they grow instead (100 MB each at 100 TB); so the table of their starts stays below 16 MB.
MAX_BUCKETS = 1_000_000
#: Bytes of the buckets that one task shuffles, one after another.
TASK_BYTES = 256 << 20


def layout(df: DataFrame, text_col: str, bucket_bytes: int, min_buckets: int) -> tuple[int, int]:
    """Number of buckets, and how many of them go to one task."""
    total = df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64)).first()[0] or 0
    n = min(max(min_buckets, MAX_BUCKETS), max(min_buckets, math.ceil(total / bucket_bytes)))
    return n, max(1, n // max(min_buckets, math.ceil(total / TASK_BYTES)))


def external_shuffle(
    df: DataFrame, shards: int = 16, seed: int = 17, *, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS,
) -> DataFrame:
    """``df``, shuffled and written to the shared folder, with ``shard`` (int) and ``slot`` (long).

    The bucket of a row comes from a seeded hash of its id and its place in the scan, so a hot
    id or a group of copies spreads like other rows; ``df`` should be a scan of a table, where
    that place does not change when a task runs again. The order depends on the seed, and on
    how the scan is split. slot counts from 0 without gaps in each shard. Rows with null
    ids or texts and repeated rows are rows like others. Columns called shard or slot are
    replaced. An empty table gives an empty result.
    """
    df = df.drop("shard", "slot")
    b, w, p, r, g = (free_name(df, x) for x in ("bucket", "within", "place", "row", "group"))
    n, per = layout(df, text_col, bucket_bytes, min_buckets)
    record = F.struct(F.col(w).alias(w), *(F.col(c) for c in df.columns))
    mixed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(p))
    scattered = (
        df.withColumn(p, F.monotonically_increasing_id())
        .withColumn(b, F.pmod(mixed, F.lit(n)).cast("int"))
        .withColumn(w, F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(p)))
        .withColumn(g, F.floor(F.col(b) / F.lit(per)).cast("int"))
        .repartition(math.ceil(n / per), g)
    )
    shuffled = written(
        scattered.groupBy(g, b).agg(F.sort_array(F.collect_list(record)).alias(r))
        .select(b, F.posexplode(F.shuffle(r, F.lit(seed))).alias(p, r))
        .select(b, p, *(F.col(r)[c].alias(c) for c in df.columns)),
        "shuffled",
    )
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    # one row of two numbers a bucket, of which there are MAX_BUCKETS at most; the texts are not shuffled for it
    starts = F.broadcast(shuffled.groupBy(b).count().select(b, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(w)))
    at = F.col(w) + F.col(p)
    return shuffled.join(starts, b).select(
        *df.columns, (at % shards).cast("int").alias("shard"), F.floor(at / F.lit(shards)).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder a shard, each in slot order over its files."""
    shards = sharded.select("shard").distinct().count() or 1
    sharded.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""The shared folder, written tables and text rules that several operators need."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, and the letters that are folded.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_TOPS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is local (as in tests) a temporary folder is made;
    on a cluster that would be another disk on each machine, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver ends."""
    top = f"{shared_dir(spark)}/skyloom/{spark.sparkContext.applicationId}"
    if top not in _TOPS:
        _TOPS.add(top)
        at, fs = _hadoop(spark, top)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    """Path and file system in the driver's JVM."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    at, fs = _hadoop(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    The lineage is cut, so a lost executor costs no earlier work.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else; other letters keep their case."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches to Python of at most ``rows`` rows while plans run inside: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)

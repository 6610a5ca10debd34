"""Labels by fold, and bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def smallest_hashes(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``ids`` (id, ...): those with the smallest hashes of their ids."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(limit)

"""Runs the filters: keyed state on streams, ordered groups on tables; other streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def out_schema(df: DataFrame, key: str, time: str, value: str, filt) -> StructType:
    own = [df.schema[c] for c in (key, time, value)]
    return StructType([*own, *(StructField(c, DoubleType()) for c in filt.columns)])


def _walk(filt, state, rows, key, time, value):
    """Filters ordered rows from a state; returns the rows that emit and the new state."""
    out = []
    for t, x in zip(rows[time], rows[value]):
        state, values = filt.step(state, float(t), float(x))
        if values is not None:
            out.append((t, x, *values))
    return out, state


def on_table(df: DataFrame, key: str, time: str, value: str, filt) -> DataFrame:
    """The filter over each key's rows in order of time; nulls in time or value are left out."""
    schema = out_schema(df, key, time, value, filt)
    rows = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, time, value)

    def run(k, g):
        import pandas as pd

        out, _ = _walk(filt, filt.start(), g.sort_values(time, kind="stable"), key, time, value)
        p = pd.DataFrame(out, columns=[time, value, *filt.columns])
        p.insert(0, key, k[0])
        return p

    return rows.groupBy(key).applyInPandas(run, schema)


def on_stream(df: DataFrame, key: str, time: str, value: str, filt) -> DataFrame:
    """The filter on a stream: a key's state is a list of doubles, kept in the state store from batch to batch.

    Rows of one batch are put in order of time; rows that come in a later batch with an earlier
    time are taken as they come, as the filters have no way back.
    """
    schema = out_schema(df, key, time, value, filt)
    rows = df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, time, value)

    def run(k, frames, state):
        import pandas as pd

        s = list(state.get[0]) if state.exists else filt.start()
        g = pd.concat(list(frames)).sort_values(time, kind="stable")
        out, s = _walk(filt, s, g, key, time, value)
        state.update(([float(v) for v in s],))
        p = pd.DataFrame(out, columns=[time, value, *filt.columns])
        p.insert(0, key, k[0])
        yield p

    return rows.groupBy(key).applyInPandasWithState(run, schema, "s array<double>", "append", "NoTimeout")


def deduplicated(df: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Rows once for each key within the delay that late rows are waited for."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def pair_statistics(edges: DataFrame) -> DataFrame:
    """Weighted mean of trusted pairs (image, value, weight, std), renewed with each batch in update mode."""
    ok = F.col("std") < 25
    return edges.groupBy("image").agg(
        (F.sum(F.when(ok, F.col("value") * F.col("weight"))) / F.nullif(F.sum(F.when(ok, F.col("weight"))), F.lit(0.0))).alias("mean"),
        F.count_if(ok).alias("pairs"),
    )


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key so far (T15), on tables and, in update mode, on streams."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), time).alias("row")).select("row.*")


def write_rates(stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "csv", **trigger):
    """Starts a query that writes a stream's rows to files (K13), each row once, and returns it.

    The sink keeps a log of the files of each finished batch beside them; read the folder with Spark,
    which goes by that log, and files of a batch that was cut short do not count. A query that is
    started again on the same ``checkpoint`` goes on behind the last finished batch, with the
    filters' state as it was then. ``trigger`` is that of Structured Streaming, ``availableNow=True`` by default.
    """
    out = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (out.option("header", True) if fmt == "csv" else out).start(path)

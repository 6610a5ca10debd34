"""A filter on a stream gives what it gives on the table."""

import pytest
from pyspark.sql import functions as F

from skyloom.streaming import filters, run


def replayed(spark, tmp_path, df, make, name, mode="append"):
    src = str(tmp_path / name)
    for k in range(3):
        df.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def data(spark):
    rows = [(k, float(t), float((t * 7 + k * 3) % 11), t // 20) for k in range(3) for t in range(60)]
    return spark.createDataFrame(rows, "k long, t double, x double, part int")


@pytest.mark.parametrize("filt", [filters.RunningMean(10), filters.Welford(), filters.WarmUpLowPass(), filters.AsymmetricEwma(), filters.FastSlow(), filters.SinceEmitted(3.0), filters.Rates(), filters.Stabilizer(), filters.StreamingModes(), filters.WindowModes()])
def test_stream_is_batch(spark, tmp_path, filt):
    df = data(spark)
    got = replayed(spark, tmp_path, df, lambda s: run.on_stream(s, "k", "t", "x", filt), f"s_{type(filt).__name__}".lower())
    key = lambda rows: sorted((r.k, r.t, *(round(r[c], 6) for c in filt.columns)) for r in rows)
    assert key(got.collect()) == key(run.on_table(df, "k", "t", "x", filt).collect())


def test_pair_statistics_update(spark, tmp_path):
    df = data(spark).select(F.col("k").alias("image"), F.col("x").alias("value"), F.lit(2.0).alias("weight"), F.col("t").alias("std"), "part")
    got = replayed(spark, tmp_path, df, run.pair_statistics, "pairs", "complete").collect()
    want = run.pair_statistics(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_duplicates(spark, tmp_path):
    rows = [("a", 0, 0), ("a", 1, 0), ("b", 2, 1), ("a", 3, 2)]
    df = spark.createDataFrame(rows, "id string, s int, part int").select("id", F.timestamp_seconds("s").alias("ts"), "part")
    got = replayed(spark, tmp_path, df, lambda s: run.deduplicated(s, "ts", "10 minutes", ["id"]), "dups")
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_file_sink_holds_each_row_once_over_restarts(spark, tmp_path):
    df, src, out = data(spark), str(tmp_path / "in"), str(tmp_path / "out")
    filt = filters.Rates()
    for k in range(3):  # the query is started again after each new file
        df.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = run.write_rates(run.on_stream(stream, "k", "t", "x", filt), out, str(tmp_path / "log"))
        q.awaitTermination(60)
        assert q.exception() is None
    # a file that no finished batch names, as an executor that was lost leaves it
    (tmp_path / "out" / "part-99999-lost.csv").write_text("k,t,x,rate\n9,9,9,9\n")
    got = spark.read.option("header", True).schema("k long, t double, x double, rate double").csv(out)
    rows = lambda d: sorted((r.k, r.t, r.x, round(r.rate, 9)) for r in d.collect())
    assert rows(got) == rows(run.on_table(df, "k", "t", "x", filt)) and got.count() == 180

import corpus_pipeline as cp
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_on_the_small_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = docs.count()
    names = docs.columns
    out = cp.drop_repeated_lines(spark, docs, FOLDER)
    assert out.columns == names and out.count() == n
    one = cp.keep_one_of_near_duplicates(spark, docs, FOLDER)
    assert one.columns == names and one.select("text").distinct().count() == one.count() < n
    left = cp.drop_contaminated(spark, docs, FOLDER)
    assert left.columns == names and 0.8 * n < left.count() <= n
    clean = cp.drop_toxic(spark, docs, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert clean.columns == names
    gone = docs.join(clean, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.filter("toxic = 1").count() >= gone.filter("toxic = 0").count()


def test_stages_take_odd_rows_and_empty_tables(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (None, "no id at all here", "en", "s", 9), (3, "same text " * 8, "en", "s", 80), (3, "same text " * 8, "en", "s", 80), (4, "same text " * 8, "en", "s", 80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, FOLDER)
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
        if name == "near duplicates":
            assert ids == sorted([1, 2, None, 3], key=str)
        elif name != "packing":
            assert ids == sorted((r[0] for r in rows), key=str)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_the_whole_run(spark):
    out = cp.run(spark, FOLDER)
    assert out.filter("length > 0").count() == out.count() > 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_rows_of_one_id_leave_the_smallest(spark):
    rows = [(3, f"text number {k} of one id " * 6, "en", "s", 9 - k) for k in range(4)] + [(3, "text number 0 of one id " * 6, "en", "a", 9)]
    for part in (rows, rows[::-1]):
        got = cp.keep_one_of_near_duplicates(spark, spark.createDataFrame(part, SCHEMA).repartition(3), FOLDER).collect()
        assert [tuple(r) for r in got] == [min(rows)]

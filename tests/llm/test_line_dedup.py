import random

import pytest

from skyloom.llm import line_dedup
from skyloom.llm.line_dedup import KEY, LineRuns, Tables, dedup_lines, line_hashes, sorted_buckets
from skyloom.llm.shared import scratch

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    owner = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                k = key(x)
                if len(k) >= 10:
                    owner[k] = min(owner.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or owner.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1000, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = random.Random(7)
    pool = ["A common line here", "a Common line here  ", "short", "", "Été était très long", "été était très long", "x" * 10, "\tsecond shared line\r", "1234567890"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "A common line here\n" * 300), (None, "A common line here"), (3, rows[3][1]), (60, "only here, a long line\nonly here, a long line")]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, kept_text string, pos int")
    for batches in (1, 3):
        got = [(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in dedup_lines(df, batches=batches).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lost string, id int")
    out = dedup_lines(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lost", "id", "kept_text", "n_lines", "n_dropped"]


def test_runs_compact_and_later_batches_lose_to_earlier(spark):
    runs = LineRuns(spark, buckets=2, fanout=2)
    for k in range(5):
        df = spark.createDataFrame([(k, f"line shared by all\nline of batch number {k}")], "doc_id long, text string")
        out = dedup_lines(df, batches=1, runs=runs).first()
        assert out.n_dropped == (k > 0)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.seen().count() == 6
    assert line_hashes(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).count() == 0


def test_runs_are_neither_shuffled_nor_sorted_again(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"line shared by all\nline of number {k % 40}") for k in range(200)], "doc_id long, text string")
    runs, tables = LineRuns(spark, buckets=3, fanout=3), Tables(spark, 3)
    lines = tables.write(tables.dealt(line_hashes(docs)), "lines")

    def plan(df):
        with sorted_buckets(spark):
            return df._jdf.queryExecution().executedPlan().toString()

    for lo in (0, 100):
        batch = spark.table(lines).filter((F.col("id") >= lo) & (F.col("id") < lo + 100)).groupBy(*KEY).agg(F.min("id").alias("owner"))
        text = plan(runs.unseen(batch))
        assert "Exchange" not in text and "Sort " not in text
        runs.add(batch)
    for df in (runs.lost(spark.table(lines)), runs.merged(runs.runs())):
        text = plan(df)
        assert "SortMergeJoin" in text and "Exchange" not in text and "Sort " not in text
    assert runs.lost(spark.table(lines)).count() == 200 - 1 + 160
    runs.drop()
    tables.drop([lines])


def test_nothing_is_left_behind(spark):
    import os

    top = os.path.dirname(scratch(spark, "x")).removeprefix("file:")
    runs = lambda: {x for x in os.listdir(top) if x.startswith(("line-run", "line-lines"))}
    before, files = {t.name for t in spark.catalog.listTables()}, runs()
    docs = spark.createDataFrame([(k, "one shared line\nand another") for k in range(9)], "doc_id long, text string")
    assert dedup_lines(docs).filter("n_dropped = 2").count() == 8
    assert {t.name for t in spark.catalog.listTables()} == before
    assert runs() == files


def test_long_lines_and_ids_of_text(spark):
    long = "a" * 3_000_000
    docs = spark.createDataFrame([("b", long + "\nshort"), ("a", "x\n" + long.upper()), ("c", "only one line of its own")], "doc_id string, text string")
    got = {r.doc_id: (r.kept_text, r.n_dropped) for r in dedup_lines(docs).collect()}
    assert got == {"a": ("x\n" + long.upper(), 0), "b": ("short", 1), "c": ("only one line of its own", 0)}

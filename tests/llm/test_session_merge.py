import random

import duckdb
import pytest

from skyloom.llm.queries import QUERIES, SQL
from skyloom.llm.session_merge import session_versions

SCHEMA = "user string, seconds long, batch long, h long"


def brute(events, gap=240):
    """Every version by sorting all events so far anew after each batch."""
    out = []
    for user in {e[0] for e in events}:
        mine, stand = [e for e in events if e[0] == user], []
        for b in sorted({e[2] for e in mine}):
            sessions = []
            for e in sorted((e for e in mine if e[2] <= b), key=lambda e: e[1]):
                if sessions and e[1] - sessions[-1][-1][1] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for x in sessions:
                new, low, high = sum(e[2] == b for e in x), x[0][1], x[-1][1]
                if new:
                    olds = [v for v in stand if v[2] >= low and v[3] <= high]
                    for v in olds:
                        v[8:] = b, low
                        stand.remove(v)
                    stand.append([user, b, low, high, len(x), new, len(olds), sum(e[3] or 0 for e in x), None, None])
                    out.append(stand[-1])
    return sorted(map(tuple, out), key=str)


def versions(spark, events, **kw):
    return sorted((tuple(r) for r in session_versions(spark.createDataFrame(events, SCHEMA), **kw).collect()), key=str)


@pytest.mark.parametrize("seed, span, slot", [(0, 3_000, 500), (1, 60_000, 1_000), (2, 400_000, 21_600)])
def test_against_sorting_all_events_after_each_batch(spark, seed, span, slot):
    r = random.Random(seed)
    events = []
    for _ in range(400):
        t = r.randrange(-span // 4, span)
        events.append((r.choice("aab"), t, t // 1800 + r.choice([0, 0, 0, 1, 2, 3]), r.choice([None, 1, r.randrange(10**9)])))
    events += events[:30]  # repeated rows count each
    assert versions(spark, events, slot=slot) == brute(events)


def test_a_session_over_many_slots_is_one(spark):
    events = [("a", 200 * k, 200 * k // 1800 + k % 3, k) for k in range(150)] + [("a", 31_000, 0, 5), ("b", 200, 9, 1)]
    got = versions(spark, events, slot=300)
    assert got == brute(events)
    assert max(v[4] for v in got) == 150


def test_late_event_joins_two_standing_sessions(spark):
    got = versions(spark, [("a", 0, 0, 1), ("a", 400, 0, 2), ("a", 200, 1, 4)])
    assert got == [("a", 0, 0, 0, 1, 1, 0, 1, 1, 0), ("a", 0, 400, 400, 1, 1, 0, 2, 1, 0), ("a", 1, 0, 400, 3, 1, 2, 7, None, None)]


def test_nulls_empty_tables_repeats_and_clashing_columns(spark):
    assert versions(spark, []) == []
    assert versions(spark, [(None, 1, 1, 1), ("a", None, 1, 1), ("a", 1, None, 1)]) == []
    many = spark.createDataFrame([("a", 5, 0, 1, 7, "x")] * 2000, SCHEMA + ", island long, olds string")
    assert [tuple(r) for r in session_versions(many).collect()] == [("a", 0, 5, 5, 2000, 2000, 0, 2000, None, None)]
    got = session_versions(many.withColumnsRenamed({"user": "slot", "seconds": "s", "batch": "user"}), "slot", "s", "user", None).collect()
    assert [tuple(r) for r in got] == [("a", 0, 5, 5, 2000, 2000, 0, 0, None, None)]


def test_plan_stays_on_the_jvm_and_broadcasts_nothing(spark):
    plan = session_versions(spark.createDataFrame([("a", 5, 0, 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Broadcast" not in plan


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.execute(SQL["op12_session_merge"]).fetchdf()
    columns = sorted(want.columns)
    got = QUERIES["op12_session_merge"](spark, folder).toPandas()
    rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).to_numpy().tolist()), key=str)
    assert sorted(got.columns) == columns and rows(got) == rows(want) and len(got) > 300

from collections import Counter

from pyspark.sql import functions as F

from skyloom.llm.sharding import external_shuffle, write_shards
from skyloom.llm.url_filter import filter_urls, host_path, rule_of


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/7x?q#f": ("www.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "http://a.example.net/de/8#x": ("a.example.net", "/de/8", "example.net/de/8", "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://badcom/en/": ("badcom", "/en/", None, None),
        "http://x.org?es/": ("x.org", "", None, None),
        "no scheme.com/en/": ("", "", None, None),
        "": ("", "", None, None),
        "ftp://ÉX.com#a/b": ("Éx.com", "", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    h, p = host_path(F.col("url"))
    from skyloom.llm.url_filter import RULES

    got = df.select("url", h.alias("h"), p.alias("p")).select("*", rule_of(F.col("h"), F.col("p"), RULES).alias("r")).collect()
    assert {r.url: (r.h, r.p, r.r and r.r.rule, r.r and r.r.verdict) for r in got} == cases


def test_query_follows_the_rules_of_its_contract(spark, tmp_path):
    from skyloom.llm.queries import op3_url_filter

    cases = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://b.net/de/1": ("net/de/", "allow"),
        "http://www.EXAMPLE.net/de/8?x": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://c.org/es/2": ("org/es/", "block"),
    }
    spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op3_url_filter(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_model_tells_the_classes_apart(spark):
    rows = [(k, f"http://good-news-{k}.example.com/en/7{k}") for k in range(120)]
    rows += [(1000 + k, f"http://xxzzq{k}.site.org/es/{k}") for k in range(120)]
    rows += [(2000, "http://good-news-5.example.org/fr/7"), (2001, "http://xxzzq7.site.net/fr/1"), (None, None), (2002, None), (7, rows[7][1])]
    df = spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, score int")
    out = filter_urls(df)
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].verdict == "allow" and by[1003].verdict == "block" and by[1003].rule == "org/es/"
    assert by[2000].verdict == "allow" and by[2001].verdict == "block" and by[2000].rule is None
    assert Counter(r.page_id for r in got)[7] == 2
    assert filter_urls(df.limit(0)).count() == 0


def test_model_reads_whole_urls(spark):
    rows = [(k, f"http://site-{k}.example.com/en/7{k}?story=daily-news-{k}") for k in range(120)]
    rows += [(1000 + k, f"http://site-{k}.site.org/es/{k}?zzq=xxzzq{k}xx") for k in range(120)]
    rows += [(2000, "http://site-5.example.org/fr/7?story=daily-news-5"), (2001, "http://site-5.example.org/fr/7?zzq=xxzzq5xx"), (2002, "daily-news"), (2003, "xxzzqxx")]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[2000].verdict == "allow" and got[2001].verdict == "block"
    assert got[2002].score > got[2003].score


def brute_scores(urls, order=4):
    """Two Witten-Bell models by dictionaries, from rows (url, verdict of the rules or None, whether they are counted)."""
    import math
    from collections import defaultdict

    seen = {v: [defaultdict(Counter) for _ in range(order + 1)] for v in ("allow", "block")}
    spell = lambda u: "\x02" * order + "".join(c if "!" <= c <= "~" else "?" for c in u or "") + "\x03"
    for u, v, counted in urls:
        if v and counted:
            t = spell(u)
            for i in range(order, len(t)):
                for k in range(order + 1):
                    seen[v][k][t[i - k : i]][t[i]] += 1
    out = []
    for u, _, _ in urls:
        t, total = spell(u), 0.0
        for i in range(order, len(t)):
            p = {}
            for v in seen:
                p[v] = 1 / 96
                for k in range(order + 1):
                    c = seen[v][k].get(t[i - k : i])
                    if c:
                        p[v] = (c[t[i]] + len(c) * p[v]) / (sum(c.values()) + len(c))
            total += math.log(p["allow"]) - math.log(p["block"])
        out.append(total / (len(t) - order))
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    from skyloom.llm import url_filter

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").limit(60)
    odd = [(9000, None), (9001, ""), (9002, "no scheme"), (9003, "http://é.com/en/ x"), (None, None), (9004, "http://a.org/es/" + "long/" * 4_000)]
    df = pages.unionAll(spark.createDataFrame(odd + [(9002, "no scheme")] * 3, "page_id long, url string"))
    h, p = host_path(F.col("url"))
    held = F.pmod(F.xxhash64(F.concat("h", "p")), F.lit(5))
    rows = df.select("page_id", "url", h.alias("h"), p.alias("p")).select("*", held.alias("f"), rule_of(F.col("h"), F.col("p"), url_filter.RULES).verdict.alias("v")).collect()
    key = lambda r: -1 if r.page_id is None else r.page_id
    want = sorted((key(r), s) for r, s in zip(rows, brute_scores([(r.url, r.v, r.f != 0) for r in rows])))
    for hot in (1000, 20):
        monkeypatch.setattr(url_filter, "HOT_GRAMS", hot)
        got = sorted((key(r), r.score) for r in filter_urls(df).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_shards_are_even_and_whole(spark, tmp_path):
    rows = [(k, f"text {k}" if k % 5 else None) for k in range(997)] + [(3, "twice")] * 40 + [(None, "n")]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, shard int, bucket string")
    out = external_shuffle(df, min_buckets=8)
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert sum(a < b for a, b in zip(order, order[1:])) < 0.6 * len(order)
    write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    assert external_shuffle(df.limit(0)).count() == 0


def test_tasks_hold_several_buckets_and_buckets_stay_below_a_number(spark, monkeypatch):
    from skyloom.llm import sharding

    df = spark.createDataFrame([(k, "x" * (k % 300)) for k in range(2000)] + [(5000, "y" * 3_000_000), (None, None)], "doc_id long, text string")
    whole = sharding.layout(df, "text", 1 << 20, 4)
    monkeypatch.setattr(sharding, "TASK_BYTES", 1 << 20)
    assert whole == (4, 1) and sharding.layout(df, "text", 1 << 14, 2) == (209, 52)
    monkeypatch.setattr(sharding, "MAX_BUCKETS", 40)
    assert sharding.layout(df, "text", 1 << 14, 2) == (40, 10)
    out = external_shuffle(df, shards=5, bucket_bytes=1 << 14, min_buckets=2)
    got = out.select("doc_id", "shard", "slot").collect()
    assert len(got) == 2002 and len({(r.shard, r.slot) for r in got}) == 2002
    n = Counter(r.shard for r in got)
    assert max(n.values()) - min(n.values()) <= 1 and all(max(r.slot for r in got if r.shard == k) == n[k] - 1 for k in n)

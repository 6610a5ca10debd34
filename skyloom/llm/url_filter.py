"""URL filter by the ratio of two character language models. DataFrame functions only.

Rules label URLs as accepted or rejected. Of each class a variable-order Markov model of
characters is counted over all labelled URLs: interpolated Witten-Bell smoothing weighs the
longest context with evidence against the shorter ones, down to a uniform law. A URL's score is
the mean over its characters of log P(accepted) - log P(rejected); the threshold is calibrated
on a fold of the labelled URLs that the counts leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fold_ascii, written

ORDER = 4
#: Characters outside printable ASCII become "?": 94 characters, the start mark and the end mark.
ALPHABET = 96
#: Grams with more than one of HOT_GRAMS of all occurrences are hot: HOT_GRAMS rows at most, sent to the executors.
HOT_GRAMS = 1000
CHUNK = 256
START, END = "\x02", "\x03"
#: Rules of the operator where none are given: (rule, verdict). The query has its own.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "block"),
    ("example.net/de/8", "allow"),
    ("org/es/", "block"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    before_query = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(before_query, "/", 1)
    return fold_ascii(host), F.substring(before_query, F.length(host) + 1, F.length(before_query))


def rule_of(host: Column, path: Column, rules: tuple) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does.

    Ties go to the rule with the longer host, then to the first in text order. The rules are a
    tuple on the driver and become one expression.
    """
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        fit = F.coalesce(fit, F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return fit


def grams(text: Column, order: int) -> Column:
    """Each character of ``text`` and the end mark, behind its ``order`` characters of context.

    The text is cut into chunks first, as the place of a character is counted from the start.
    """
    safe = F.concat(F.lit(START * order), F.regexp_replace(text, "[^\\x21-\\x7e]", "?"), F.lit(END))
    chunks = F.transform(F.sequence(F.lit(1), F.length(text) + 1, F.lit(CHUNK)), lambda at: F.substring(safe, at, F.lit(CHUNK + order)))
    return F.flatten(F.transform(chunks, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - order), lambda i: F.substring(c, i, F.lit(order + 1)))))


def smoothed(distinct: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(g, n, s): log-likelihood difference of each distinct gram (g, n) under the two models.

    counts: (g, a, r), how often the gram was seen in accepted and in rejected URLs. Contexts of
    up to two characters are at most ALPHABET**2 rows with ALPHABET entries each, so those
    tables are broadcast; longer contexts are joined as Spark sees fit.
    """
    p_a = p_r = F.lit(1.0 / ALPHABET)
    out = distinct.select("g", "n", p_a.alias("pa"), p_r.alias("pr"))
    for k in range(order + 1):
        by_char = (
            counts.select(F.substring("g", order + 1 - k, k).alias(f"c{k}"), F.substring("g", order + 1, 1).alias("x"), "a", "r")
            .groupBy(f"c{k}", "x").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        )
        context = by_char.groupBy(f"c{k}").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"),
            F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr"),
            F.map_from_entries(F.collect_list(F.struct("x", F.struct("a", "r").alias("n")))).alias("m"),
        )
        if k <= 2:
            context = F.broadcast(context)
        out = out.withColumn(f"c{k}", F.substring("g", order + 1 - k, k)).join(context, f"c{k}", "left")
        seen = F.element_at("m", F.substring("g", order + 1, 1))

        def mixed(p: str, n: str, t: str, of: str) -> Column:
            c = F.coalesce(seen[of], F.lit(0))
            return F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.col(p)).otherwise((c + F.col(t) * F.col(p)) / (F.col(n) + F.col(t)))

        out = out.select("g", "n", mixed("pa", "na", "ta", "a").alias("pa"), mixed("pr", "nr", "tr", "r").alias("pr"))
    return out.select("g", "n", (F.log("pa") - F.log("pr")).alias("s"))


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: tuple = RULES, order: int = ORDER, folds: int = 5,
) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold), one row for each row of ``pages``.

    verdict: the rule's, else ``allow`` where score >= threshold and ``block`` below. The models
    read the whole URL, the rules host and path; URLs of one host and path share a fold. The
    threshold lies between the mean scores of the two classes in the calibration fold, at equal
    distance in standard deviations (0 where a class has fewer than two URLs there). With no
    labelled URL of a class its model is the uniform law. Null urls and urls without ``://`` have
    empty host and path; null urls are scored as the empty text. Null ids and repeated rows keep
    their rows. An empty table gives an empty result.
    """
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", F.coalesce("url", F.lit("")))
    urls = urls.withColumn("fold", F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(folds)))
    kind = F.when(F.col("fold") != 0, F.col("fit.verdict"))
    counts = (
        urls.select(kind.alias("kind"), "text").filter(F.col("kind").isNotNull())
        .select("kind", F.explode(grams(F.col("text"), order)).alias("g"))
        .groupBy("g").agg(F.count_if(F.col("kind") == "allow").alias("a"), F.count_if(F.col("kind") == "block").alias("r"))
    )
    counts = written(counts, "url-grams")
    rows = written(urls.groupBy("id", "url").agg(F.count("*").alias("m")), "url-rows")
    each = rows.select("id", "url", "m", F.explode(grams(F.coalesce("url", F.lit("")), order)).alias("g"))
    seen = written(each.groupBy("g").agg(F.count("*").alias("n")), "url-grams-seen")
    total = seen.agg(F.sum("n")).first()[0] or 0
    scores = written(smoothed(seen, counts, order), "url-gram-scores")
    hot = F.broadcast(scores.filter(F.col("n") > total // HOT_GRAMS + 1).select("g", "s"))
    rest = each.join(hot.select("g"), "g", "left_anti").join(scores.select("g", "s"), "g")
    parts = each.join(hot, "g").unionByName(rest)
    scored = parts.groupBy("id", "url").agg(F.avg("s").alias("score"), F.first("m").alias("m"))
    # a row for each of the m rows that are alike, by two steps of 4096
    step = 4096
    scored = scored.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / step))))
    scored = scored.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(step), F.col("m") - F.col("k") * step)))).select("id", "url", "score")
    scored = written(scored, "url-scores")
    host, path = host_path(F.col("url"))
    scored = scored.select("id", host.alias("host"), path.alias("path"), "score").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    held = F.pmod(F.xxhash64(F.concat("host", "path")), F.lit(folds)) == 0
    allow, block = (F.when(held & (F.col("fit.verdict") == v), F.col("score")) for v in ("allow", "block"))
    a, sa, b, sb = scored.agg(F.avg(allow), F.stddev_pop(allow), F.avg(block), F.stddev_pop(block)).first()
    threshold = 0.0 if a is None or b is None or sa + sb == 0 else (a * sb + b * sa) / (sa + sb)
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), judged).alias("verdict"), "score", F.lit(threshold).alias("threshold"),
    )

"""The queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontam import contaminated
from .hard_negatives import mine
from .jaccard_join import component_ids
from .line_crf import score_quality
from .line_dedup import dedup_lines
from .packing import pack
from .prefix_hash import edited_fingerprints
from .session_merge import session_versions
from .sharding import external_shuffle
from .token_files import read_token_files, write_token_files
from .toxicity import score_toxicity
from .url_filter import filter_urls


#: The contract's rules of op3_url_filter: (rule, verdict).
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules=URL_RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, num=85, den=100)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest is taken where the edited text is made, so that texts are not written once more
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op12_session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").dropna()
    crc = lambda text: F.crc32(text.cast("binary"))
    eight = F.expr("(conv_id - pmod(conv_id, 8)) div 8")
    coded = turns.select("conv_id", "turn", eight.alias("eight"), crc(F.col("conv_id").cast("string")).alias("c"), crc(F.concat_ws(":", "conv_id", "turn")).alias("h"))
    timed = coded.select(
        (2 * F.col("eight") + F.col("c") % 2).alias("user"), "h", F.expr("h div 600").alias("g"),
        (F.expr("c div 2") % 7200 + 300 * F.col("turn") + F.col("h") % 600).alias("seconds"),
    )
    late = F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)
    # floors, so that turns below 0 fall in batches below 0
    batch = F.expr("(seconds - pmod(seconds, 1800)) div 1800") + late
    return session_versions(timed.select("user", "seconds", batch.alias("batch"), "h"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_packing, op3_url_filter, op4_quality, op5_toxicity, op6_sharding, op7_jaccard_join, op8_token_files, op9_decontamination, op10_nearest,
        op11_fingerprints, op12_session_merge, op13_hard_negatives,
    )
}

SQL = {
    "op1_line_dedup": r"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (
  SELECT k.doc_id, k.line, k.pos, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone
  FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op12_session_merge": """
WITH table256 AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)),
               lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
        FROM range(256) r(i))),
crc AS (
  SELECT conv_id, turn,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS c,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id || ':' || turn, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS h
  FROM conversations, table256 WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
timed AS (
  SELECT 2 * floor(conv_id / 8)::BIGINT + c % 2 AS "user", h, h // 600 AS g,
         c // 2 % 7200 + 300 * turn + h % 600 AS s FROM crc),
ev AS (
  SELECT "user", s, h, floor(s / 1800)::BIGINT + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM timed),
sofar AS (
  SELECT x."user", x.batch, e.s, e.h, e.b = x.batch AS fresh,
         coalesce(e.s - lag(e.s) OVER (PARTITION BY x."user", x.batch ORDER BY e.s) > 240, true) AS cut
  FROM (SELECT DISTINCT "user", b AS batch FROM ev) x JOIN ev e ON e."user" = x."user" AND e.b <= x.batch),
piece AS (
  SELECT *, sum(cut::INT) OVER (PARTITION BY "user", batch ORDER BY s, NOT cut) AS k FROM sofar),
version AS (
  SELECT "user", batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (WHERE fresh) AS n_new,
         sum(h)::BIGINT AS h_sum
  FROM piece GROUP BY "user", batch, k HAVING bool_or(fresh)),
gone AS (
  SELECT v."user", v.batch, v.start_s, min(w.batch) AS retracted_batch, arg_min(w.start_s, w.batch) AS retracted_start_s
  FROM version v JOIN version w ON w."user" = v."user" AND w.batch > v.batch AND w.start_s <= v.start_s AND w.end_s >= v.end_s
  GROUP BY 1, 2, 3),
made AS (
  SELECT "user", retracted_batch AS batch, retracted_start_s AS start_s, count(*) AS n FROM gone GROUP BY 1, 2, 3)
SELECT v.*, coalesce(m.n, 0) AS n_retracted, g.retracted_batch, g.retracted_start_s
FROM version v LEFT JOIN gone g USING ("user", batch, start_s) LEFT JOIN made m USING ("user", batch, start_s)
""",
    "op13_hard_negatives": """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
""",
}

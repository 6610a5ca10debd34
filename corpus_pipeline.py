"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.decontam import contaminated
from skyloom.llm.jaccard_join import near_duplicates
from skyloom.llm.line_dedup import dedup_lines
from skyloom.llm.packing import pack
from skyloom.llm.shared import written
from skyloom.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller id holds go from the texts; null texts stay null."""
    out = dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the smallest id stays; rows without id stay.

    Rows that share an id are one document; the smallest row in the order of the columns stands for it.
    """
    first = near_duplicates(docs).filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    kept = first.select("_row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: The classifier, the tokenizer and the alignment have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs

"""Training corpus: drop toxic documents and near copies, remove benchmark passages, mix, encode.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns what the
next one gets as ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.llm import decontam, jaccard, mixing, tokens, toxicity
from vitalspan.llm.queries import table, tokenizer_file
from vitalspan.session import scratch_path

SEED = "mix-1"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in proportion to the square root of their source's size."""
    return mixing.replicate(docs, mixing.source_rates(docs), SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order that mixing has drawn, read back.

    Copies of a document are the same row, so they are counted and numbered again, and each
    place in the global order gets the same row.
    """
    same = docs.groupBy("doc_id", F.md5("text").alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    copies = same.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number"))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("number").cast("string")))
    numbered = copies.select("doc_id", "text", key.alias("shuffle_key"))
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(numbered, path, tokenizer_file(), order=["shuffle_key"])
    return tokens.read_tokens(spark, path, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: A byte-pair encoding has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

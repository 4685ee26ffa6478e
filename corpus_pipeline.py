"""Training-data pipeline over ``documents``: language, boilerplate lines, near duplicates, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbook.llm import language_id, line_dedup, ngram_join, packing
from signalbook.llm.frames import bounded_batches
from signalbook.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determinable language: no letters, or no language more likely than the others
    together. All columns stay as they are."""
    bounded_batches(spark)
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.train(docs.filter(~language_id.held_out()), pieces)
    return language_id.keep_identified(docs, model, min_score=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines found in over a tenth of their source's distinct texts; ``n_chars`` follows the text. Copies of a
    document are left whole for the next stage, which keeps one of them."""
    done = line_dedup.drop_site_lines(docs)
    chars = F.when(F.col("_lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return done.withColumn("n_chars", chars).drop("_lines_dropped")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    bounded_batches(spark)
    return ngram_join.keep_one(docs, shingle=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packed)]

# Language and packing rest on models and tokenizers: no SQL says the same. The stages are tested against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs

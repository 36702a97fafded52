"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, contaminated
documents go, and what is left is encoded with BPE. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe, decontaminate, ngram_join, toxicity
from tidewater.llm.common import WRITTEN, discard, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the toxic ones; null and empty texts stay, repeated rows are judged alike, without labels all stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the least id; null and empty texts all stay."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that hold benchmark passages over the coverage limit; null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; null texts are empty, repeated rows get a row each."""
    return bpe.digests(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(WRITTEN)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(spark, before, docs)  # what led to a stage's table is not read again
    return docs


#: SQL has neither the fitted classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None

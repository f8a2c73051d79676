"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage calls one operator of ``codemap.llm`` over all rows that its predecessor kept. All stages
but the last return the columns of documents; the last one returns the packed pieces.
"""
from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession

from codemap.llm import decontaminate, packing, quality, secrets, simhash
from codemap.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, counts: Observation | None = None) -> DataFrame:
    """Documents that policy v2 of the rule ledger keeps; counts observes what each rule rejects."""
    return quality.accepted(docs, "v2", counts=counts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits): the one with the smallest id."""
    return simhash.keep_one(docs, ngram=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark table (5-word shingles, containment 0.8)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ngram=5, threshold=0.8)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, capacity=4096), capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Packing has no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, one after the other; logs the ledger's counts of the quality rules."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if stage is quality_rules:
            counts = Observation("quality_rules")
            docs = scratch.keep(stage(spark, docs, sf_dir, counts), f"{i}-{name}")
            logging.getLogger(__name__).info("%s: %s", name, counts.get)
        else:
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs

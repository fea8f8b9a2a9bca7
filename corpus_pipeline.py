"""Corpus pipeline: quality, near-duplicates, source mix, packing; each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, packing, quality, simhash, tokens
from ledgerloom.llm.workers import importable
from ledgerloom.session import adopt, stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep_good(docs, importable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    importable(spark)
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one of each source may come in part."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in training sequences."""
    importable(spark)
    return packing.pack_documents(docs, tokens.word_file())


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", without_near_duplicates),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

# Fingerprints, the fitted classifier and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and reread."""
    docs = importable(adopt(spark)).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs

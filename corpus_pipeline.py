"""The corpus pipeline: quality classifier, near-dedup, decontamination, source mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, mixing, neardup, quality, tokens
from graphloom.llm.util import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenize_documents(docs)


STAGES = [("quality", classify), ("near_dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokenize)]

#: Trees, XXH64, keyed hashes and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written and read again; rows as the token stage gives them.

    Null and empty texts fail or pass the quality stage like any text by their score; of those that pass, near_dedup keeps one. Null
    ids, null sources and repeated rows are rows like others; of equal or alike texts the one of the least id stays, nulls last, and of equal
    ids that of the least text hash. Columns beyond those of documents, whatever their names, go along up to the mix and end there. An empty
    table gives no rows; without labels every text scores 0.5 and passes; without items nothing is contaminated.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The documents' way to training data: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from somatlas.llm import decontam, langid, nearsets, packing, toxicity
from somatlas.llm.queries import tokenizer_path
from somatlas.runtime import Scratch, ship_package, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language no score of 0.4 names, go."""
    ship_package(spark)
    return langid.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go."""
    ship_package(spark)
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; links are pairs at 0.8 or more by five-word shingles."""
    ship_package(spark)
    return nearsets.keep_representatives(docs, Scratch(spark, "dedup"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    ship_package(spark)
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    ship_package(spark)
    return packing.pack(docs, Scratch(spark, "pack"), tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Trained models, tokenization and linear programs are outside SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_somatlas_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: stages of text operators over documents, each one's Parquet output the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, near_dup, packing, pii, toxicity
from lodestone.llm._spark import new_path, paths, release
from lodestone.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the documents it is given and their labels."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are replaced by their kind."""
    return pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut and packed into training sequences: one row per piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written and read again; what earlier stages wrote goes as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = paths(spark)
    for _, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        path = new_path(spark)
        rows.write.parquet(path)
        release(spark, keep={*others, path})
        docs = spark.read.parquet(path)
    return docs


#: The stages train models, cut tokens and link near copies; SQL has no form for them.
ORACLE_SQL = None

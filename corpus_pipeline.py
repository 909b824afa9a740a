"""Corpus pipeline: each stage reads what its predecessor wrote and keeps the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from exposurekit.llm import stages
from exposurekit.session import cut_lineage

STAGES = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("mixed", stages.mixed),
    ("packed", stages.packed),
]

ORACLE_SQL = None  # SimHash, language model and tokenizer are beyond SQL; tests hold run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

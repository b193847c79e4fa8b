"""The corpus pipeline: quality, exact copies, near copies, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heaplens.llm.pipeline import bpe_stage, exact_stage, mix_stage, quality_stage, simhash_stage

STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", simhash_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: A learned classifier can't be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's docs.

    Each stage's docstring says what it does with nulls, ties and repeated rows; null texts count as empty throughout. An empty table gives an empty result.
    """
    from heaplens.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns the columns of docs, the last one tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .exact_dedup import exact_dedup
from .mixing import DEFAULT_PARTS, PARTS, mix_sources
from .quality import score_quality, train_quality
from .simhash import near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels that are not held out. Null and empty texts have one score and so stay or go together; repeated rows likewise. An empty table stays empty."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal normalised texts; null counts as empty, a null id as the largest, and one of rows repeated in full stays. An empty table stays empty."""
    return exact_dedup(docs, survivors_only=True)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (word 5-shingle similarity from 0.8), the one with the smallest id. Documents without an id or without words stay, as do all rows of an id that stays. An empty table stays empty."""
    gone = near_duplicates(docs).select(F.col("node").alias("doc_id"))
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def _places(docs: DataFrame) -> DataFrame:
    """doc_id and mix_pos, its place in the mix (the first one of a repeated id). The same rows give the same places."""
    return mix_sources(docs, PARTS, DEFAULT_PARTS).groupBy("doc_id").agg(F.min("mix_pos").alias("mix_pos"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix: sorted within files, and file by file. Rows that repeat an id stand together, at the first one's place; a null source is a source. An empty table stays empty."""
    rows = docs.alias("d").join(_places(docs).alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select("d.*", F.col("p.mix_pos").alias("_mix_pos"))
    return rows.repartitionByRange("_mix_pos").sortWithinPartitions("_mix_pos").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document as digests, those of the decoded bytes, and mix_pos, as files that are read again come in any order. Null texts have no ids; a null id is an id like any other here, and rows that repeat an id meet each of its places; an empty table gives an empty result."""
    digests = bpe_digests(docs).alias("d")
    return digests.join(_places(docs).alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select("d.*", "p.mix_pos")

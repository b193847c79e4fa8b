"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of the surviving groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Runs of ASCII white space count as one space.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _repeated(keys: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """Rows of ``keys`` whose values in ``columns`` occur more than once.

    Values that more than one in ``most`` rows have, of which there are at most ``most``, are literals of the plan, so that their rows needn't meet in one task; the others
    are counted and joined.
    """
    counts = materialise(keys.groupBy(*columns).count().where("count > 1"), "exact")
    often = counts.where(F.col("count") > max(1, keys.count() // most)).select(F.struct(*columns).alias("v"))
    value = F.struct(*columns)
    known = often.agg(F.collect_list("v").alias("known")).first()["known"]
    if not known:
        return keys.join(counts.select(*columns), columns, "left_semi")
    hot = value.isin([F.struct(*[F.lit(v[c]).cast(dict(keys.dtypes)[c]).alias(c) for c in columns]) for v in known])
    return keys.where(hot).unionByName(keys.where(~hot).join(counts.select(*columns), columns, "left_semi"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digests: bool = False, survivors_only: bool = False) -> DataFrame:
    """One row for each input row: ``id_col``, keep_id, group_size, kept, and text_sha256. With ``survivors_only``, the input's own columns of the rows that stay.

    Rounds: rows whose normalised length is unique leave first, then those whose (length, prefix hash) is unique; only the
    rest have their full text read and hashed with SHA-256, which decides. ``text_sha256`` is null for rows that left early
    unless ``digests`` asks for it. Grouping is on counts with map-side combining, so a group of any size is one small row;
    the texts move only in the join that picks the surviving rows.

    Null texts count as empty and so equal one another. Of equal texts the smallest id stays; a null id is larger than any other.
    Repeated rows (equal id and text) are copies of each other: one of them has ``kept``. An empty table gives an empty
    result. Other columns are not read.
    """
    norm = normalised("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*docs.columns).alias("whole")] if survivors_only else []))
    # sized by the normalised text; what is stored is the text as it came, so that rows that stay can be returned
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*", F.length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("prefix"))
    rows = materialise(rows.drop("text") if survivors_only else rows, "exact")  # its narrow columns are read without the texts
    keys = rows.select("row", "len", "prefix")
    # whole texts meet row numbers by a merge join at every size: the numbers grow with the corpus and are never broadcast
    survivors = _repeated(_repeated(keys, ["len"]), ["len", "prefix"]).select("row").hint("merge")
    texts = rows.select("row", "id", (F.col("whole").getField(text_col) if survivors_only else F.col("text")).alias("text"))
    full = materialise(texts.join(survivors, "row", "left_semi").select("row", "id", F.sha2(norm, 256).alias("sha")), "exact")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    groups = full.groupBy("sha").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    decided = full.join(groups, "sha").select("row", F.col("sha").alias("full_sha"), "n", F.col("first.id").alias("keep_id"), (F.col("row") == F.col("first.row")).alias("is_kept"))
    if survivors_only:
        gone = decided.where("NOT is_kept").select("row").hint("merge")
        return rows.select("row", "whole").join(gone, "row", "left_anti").select("whole.*")
    sha = F.sha2(norm, 256) if digests else F.lit(None).cast("string")
    out = rows.select("row", "id", sha.alias("own_sha")).join(decided, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce("is_kept", F.lit(True)).alias("kept"),
        F.coalesce("full_sha", "own_sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` over all of ``documents``, with the digest of every row."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""

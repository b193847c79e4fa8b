"""Chat formatting after collapsing cumulative snapshots: a conversation that is a prefix of a longer one goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, row_digest


def chat_format(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    start: str = "<|im_start|>", end: str = "<|im_end|>",
) -> DataFrame:
    """One row for each maximal conversation: ``id_col``, n_turns, n_copies, rendered.

    Each conversation's turns are put in order and a rolling SHA-256 over (role, text) gives one hash per prefix. A
    conversation whose last hash is a proper-prefix hash of another is an earlier snapshot of it and goes (anti-join);
    of equal conversations the smallest id stays and n_copies counts them. Grouping of the hashes is map-side combined, so a
    first turn that everybody shares, or a conversation logged a million times, is one row per task.

    Turns sort by turn, then role, then text (nulls first); rows repeated in full within a conversation count once. A null role
    renders as "user", a null text as empty; rows of a null id form one conversation, which sorts after all others.
    Marker strings inside a text lose their "<|" to "< |", so that a text cannot open or close a turn. The turn numbers
    themselves don't count. Other columns are not read; an empty table gives an empty result. What is gathered in one row
    is one conversation, as its rendered form has to be.
    """
    turns = conversations.select(F.col(id_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    digests = F.transform("turns", lambda t: row_digest(t["role"], t["text"]))
    hashes = F.aggregate(
        digests, F.array().cast("array<string>"),
        lambda acc, d: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")), d), 256))),
    )
    convs = materialise(convs.withColumn("prefixes", hashes), "chat")
    ends = convs.select("conv", F.element_at("prefixes", -1).alias("h"))
    distinct = ends.groupBy("h").agg(F.min(F.struct(F.col("conv").isNull(), "conv"))["conv"].alias("conv"), F.count("*").alias("n_copies"))
    inner = convs.select(F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("h")).distinct()
    maximal = distinct.join(inner, "h", "left_anti").select("conv", "n_copies")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(start), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(f"{end}\n"))), "")
    kept = convs.alias("c").join(maximal.alias("m"), F.col("c.conv").eqNullSafe(F.col("m.conv")))
    return kept.select(F.col("c.conv").alias(id_col), F.size("turns").cast("bigint").alias("n_turns"), "n_copies", rendered.alias("rendered"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat_format`` over all of ``conversations``."""
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
), o AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(sha256(length(role) || ':' || role || text), ',') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), ends AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM o WHERE k = n_turns GROUP BY prefix
), kept AS (
  SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM o WHERE k < n_turns)
)
SELECT conv_id, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM o JOIN kept USING (conv_id) GROUP BY conv_id
"""

"""Mixing sources to target weights by a Pfair schedule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def _schedule(sources: Column, cycle: Column) -> Column:
    """The slots of one cycle, as array<struct<source index, block>>.

    Block j (from 1) of a source with ``parts`` of the ``cycle`` slots is released at floor((j-1) * cycle / parts) and due
    by ceil(j * cycle / parts). Each slot goes to the released block with the earliest deadline; all deadlines hold,
    as the parts fill the cycle exactly.
    """
    state = F.struct(
        F.transform(sources, lambda s: F.lit(0).cast("bigint")).alias("done"),
        F.array().cast("array<struct<i:int,j:bigint>>").alias("slots"),
    )

    def step(acc, slot):
        due = F.transform(
            sources,
            lambda s, i: F.when(
                (F.get(acc["done"], i) < s["parts"]) & (F.floor(F.get(acc["done"], i) * cycle / s["parts"]) <= slot),
                F.struct(F.ceil((F.get(acc["done"], i) + 1) * cycle / s["parts"]).alias("due"), i.alias("i")),
            ),
        )
        pick = F.array_min(due)["i"]
        return F.struct(
            F.transform(acc["done"], lambda n, i: n + F.when(i == pick, 1).otherwise(0)).alias("done"),
            F.concat(acc["slots"], F.array(F.struct(pick.alias("i"), (F.get(acc["done"], pick) + 1).alias("j")))).alias("slots"),
        )

    return F.aggregate(F.sequence(F.lit(0), cycle.cast("int") - 1), state, step, lambda acc: acc["slots"])


def mix_sources(
    docs: DataFrame, weights: Mapping[str, int] | None = None, default_parts: int = 1, block_rows: int = 64, id_col: str = "doc_id",
    source_col: str = "source", max_cycle: int = 4096, max_sources: int = 256,
) -> DataFrame:
    """One row for each input row: ``id_col``, ``source_col``, block, release, deadline, slot, mix_pos.

    weights: whole parts by source, ``default_parts`` for those not named; a source's target weight is its share of all parts.
    Its rows, in the order of md5(id), are cut into blocks of ``block_rows``. Slot t of the mix takes the released block with the
    earliest deadline (block k from 0 is released at floor(k/w) and due by ceil((k+1)/w)), so after any number of
    slots a source is less than one block from its weight. The schedule repeats after sum(parts) slots and is computed once for
    one cycle. Where a source has run out its slots are passed over; no row is dropped or repeated. mix_pos is the
    row's place (from 0) in the mixed sequence, without gaps.

    Rows are numbered within (source, 4096 ranges of the hash), and ranges are offset by running counts, so a source with
    any share of the rows is dealt over all tasks. The table of slots is broadcast; it has at most ``max_cycle`` rows and
    ``max_sources`` sources, beyond which the query fails with a message.

    A null source is a source of its own (it takes ``default_parts``). Ties, null ids and repeated rows get distinct places in an order that is
    not defined between them. Texts are not read. An empty table gives an empty result.
    """
    parts = F.lit(default_parts).cast("bigint")
    if weights:
        if min(weights.values()) < 1 or default_parts < 1:
            raise ValueError("parts are whole numbers from 1")
        named = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
        parts = F.coalesce(F.try_element_at(named, F.col("source")).cast("bigint"), parts)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h")).withColumn("bin", F.substring("h", 1, 3))
    counts = materialise(rows.groupBy("source", "bin").count(), "mix")
    offsets = counts.select("source", "bin", (F.sum("count").over(W.partitionBy("source").orderBy("bin")) - F.col("count")).alias("offset"))

    totals = counts.groupBy("source").agg(F.sum("count").alias("n")).withColumn("parts", parts)
    plan = totals.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("key"), "source", "parts", "n"))).alias("sources"), F.sum("parts").alias("cycle"))
    plan = plan.where("size(sources) > 0").withColumn(
        "sources",
        F.when(F.size("sources") > max_sources, F.raise_error(F.lit(f"more than {max_sources} sources")))
        .when(F.col("cycle") > max_cycle, F.raise_error(F.lit(f"the parts add up to more than {max_cycle}"))).otherwise(F.col("sources")),
    )
    slots = plan.withColumn("slots", _schedule(F.col("sources"), F.col("cycle")))
    slots = slots.select("sources", "cycle", "slots", F.posexplode("slots").alias("at", "slot"))
    # blocks of each source before a slot of the cycle
    before = F.transform("sources", lambda s, i: F.size(F.filter(F.slice("slots", F.lit(1), F.col("at")), lambda x: x["i"] == i)))
    mine = F.get("sources", F.col("slot.i"))
    slots = slots.select(
        mine["source"].alias("source"), mine["parts"].alias("parts"), "cycle", F.col("at").cast("bigint").alias("at"), (F.col("slot.j") - 1).alias("j"),
        F.transform(F.arrays_zip("sources", before.alias("before")), lambda x: F.struct(x["sources"]["parts"].alias("parts"), x["sources"]["n"].alias("n"), x["before"].cast("bigint").alias("before"))).alias("others"),
    )
    slots = materialise(slots, "mix")
    shares = slots.where("j = 0").select(F.col("source").alias("s"), "parts", "cycle")

    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("source", "bin").orderBy("h", "id")) - 1).alias("r")
    rows = rows.join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bin") == F.col("o.bin")))
    rows = rows.select("r.id", "r.source", (F.col("o.offset") + F.col("r.rn")).alias("n")).withColumn("block", F.floor(F.col("n") / block_rows))
    rows = rows.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", F.floor(F.col("block") / F.col("parts")))
    rows = rows.withColumn("jj", F.col("block") - F.col("turn") * F.col("parts")).drop("parts", "cycle").alias("r")
    rows = rows.join(F.broadcast(slots.alias("p")), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.jj") == F.col("p.j")))
    ahead = F.aggregate("p.others", F.lit(0).cast("bigint"), lambda acc, x: acc + F.least(x["n"], (F.col("turn") * x["parts"] + x["before"]) * block_rows))
    base = F.col("turn") * F.col("p.cycle")
    return rows.select(
        F.col("r.id").alias(id_col), F.col("r.source").alias(source_col), "block",
        (base + F.floor(F.col("j") * F.col("p.cycle") / F.col("p.parts"))).alias("release"),
        (base + F.ceil((F.col("j") + 1) * F.col("p.cycle") / F.col("p.parts"))).alias("deadline"),
        (base + F.col("at")).alias("slot"),
        (ahead + F.col("n") - F.col("block") * block_rows).alias("mix_pos"),
    )


#: Of the production mix: the source with the most rows has five parts, each other source two.
PARTS = {"src0": 5}
DEFAULT_PARTS = 2


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix_sources`` over all of ``documents`` with the production mix."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), PARTS, DEFAULT_PARTS)


OP1_SQL = """
WITH RECURSIVE s AS (
  SELECT source, CASE WHEN source = 'src0' THEN 5 ELSE 2 END AS parts, row_number() OVER (ORDER BY coalesce(source, '')) AS i FROM documents GROUP BY source
), c AS (
  SELECT list(parts::BIGINT ORDER BY i) AS p, sum(parts)::BIGINT AS q FROM s
), e AS (
  SELECT 0::BIGINT AS t, [0::BIGINT FOR x IN p] AS done, 0::BIGINT AS k FROM c
  UNION ALL
  SELECT t + 1, [CASE WHEN i = pick THEN done[i] + 1 ELSE done[i] END FOR i IN range(1, len(done) + 1)], pick FROM (
    SELECT t, done, list_min([((done[i] + 1) * q + p[i] - 1) // p[i] * 1000 + i FOR i IN range(1, len(p) + 1) IF done[i] < p[i] AND done[i] * q // p[i] <= t]) % 1000 AS pick
    FROM e, c WHERE t < q
  )
), slots AS (
  SELECT t - 1 AS place, k AS i, done[k] - 1 AS j FROM e WHERE t > 0
), d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rn FROM documents
), b AS (
  SELECT doc_id, d.source, rn, rn // 64 AS block, rn // 64 // parts AS turn, rn // 64 % parts AS j, parts, i FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, block, turn * q + j * q // parts AS release, turn * q + ((j + 1) * q + parts - 1) // parts AS deadline, turn * q + place AS slot,
       row_number() OVER (ORDER BY turn * q + place, rn) - 1 AS mix_pos
FROM b JOIN slots USING (i, j), c
"""

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of our own, by application, for sessions on one machine that have none set.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own if everything runs in one process, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set")
        path = _own_folders.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="heaplens-shared-")
        _own_folders[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later jobs neither recompute it nor depend on any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path, for tables that are dropped again by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``stored``, through Spark's own file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Lower the session's rows in an Arrow batch to ``rows``: of whole texts the default of 10,000 is many MB, held by each Python worker and by the JVM beside it."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, rows)


def row_digest(*columns) -> Column:
    """SHA-256 over columns without nulls; the length of each but the last goes before it, so that what belongs to which can't shift."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    return F.sha2(F.concat(*[x for c in parts[:-1] for x in (F.length(c).cast("string"), F.lit(":"), c)], parts[-1]), 256)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    edges: columns ``a``, ``b`` (bigint, not null; loops and repeats are allowed). Returns ``node``, ``component``
    (smallest node reachable), one row for each node but the smallest of each component.
    Each round is two grouped minima with map-side combining and two joins that adaptive execution may split; the edge list
    is cut from its lineage after each round in the shared folder. Nothing is gathered on the driver but two sums per round.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, path = stored(pairs, "cc")
    before = None
    while True:
        # large star: every neighbour larger than u links to the smallest neighbour of u (u included)
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and u itself link to the smallest neighbour
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after, new_path = stored(small.where("u <> v").distinct(), "cc")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        pairs, path = after, new_path
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def split_heavy(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Add ``part`` so that any two rows of a key meet in one (key, part) and no such group has more than about 2 * ``limit`` rows.

    A key of up to ``limit`` rows keeps one part. A larger one is dealt by hash into n chunks of about ``limit`` rows and every
    pair of chunks is a part, so a hot key becomes many groups instead of one. ``chunk`` tells the two chunks of a part apart (0 if the key has one part).
    """
    heavy = rows.groupBy(key).count().where(F.col("count") > limit).select(F.col(key).alias("heavy_key"), F.ceil(F.col("count") / limit).alias("n_chunks"))
    rows = rows.join(heavy, F.col(key) == F.col("heavy_key"), "left")
    chunk = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in (key, "heavy_key", "n_chunks")]), F.col("n_chunks"))
    rows = rows.withColumn("chunk", chunk)
    others = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1), lambda x: F.least(x, F.col("chunk")) * F.col("n_chunks") + F.greatest(x, F.col("chunk")))
    parts = F.when(F.col("n_chunks").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(others)
    return rows.withColumn("part", F.explode(parts)).withColumn("chunk", F.coalesce("chunk", F.lit(0))).drop("heavy_key", "n_chunks")


def star_edges(a, b):
    """numpy: spanning star edges (node, smallest node) of the graph with edges a[i]-b[i]; at most one for each node."""
    import numpy as np

    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[i] == label[j]).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]

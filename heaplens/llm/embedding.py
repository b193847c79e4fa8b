"""Embedding near-dedup by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, split_heavy, star_edges


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Trees of recursive random splits: a random direction for each tree and level, a median threshold for each node."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.dim = trees, depth, sample.shape[1]
        directions = rng.standard_normal((self.dim, trees, depth))
        self.directions = directions / np.sqrt((directions**2).sum(axis=0, keepdims=True))
        #: thresholds[tree][level][path]; below nodes that the sample doesn't reach, zero, so that splits go on
        self.thresholds = [[np.zeros(1 << level) for level in range(depth)] for _ in range(trees)]
        where = np.tensordot(sample, self.directions, 1)
        for t in range(trees):
            path = np.zeros(len(sample), np.int64)
            for level in range(depth):
                order = np.argsort(path, kind="stable")
                nodes, first = np.unique(path[order], return_index=True)
                for node, rows in zip(nodes, np.split(order, first[1:])):
                    if len(rows) >= 8:
                        self.thresholds[t][level][node] = np.median(where[rows, t, level])
                path = path * 2 + (where[:, t, level] > self.thresholds[t][level][path])

    def leaves(self, x: np.ndarray, depths: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) of each leaf that a row falls in; near a threshold (within ``spill``) it goes both ways."""
        rows, trees, paths = [], [], []
        where = np.tensordot(x, self.directions, 1)
        for t in range(self.trees):
            row, path = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                done = depths[row] <= level
                gap = where[row, t, level] - self.thresholds[t][level][np.where(done, 0, path)]
                right = gap > 0
                both = ~done & (np.abs(gap) <= spill)
                down = np.where(done, path, path * 2 + right)
                row, path = np.concatenate([row, row[both]]), np.concatenate([down, path[both] * 2 + ~right[both]])
            rows.append(row)
            trees.append(np.full(len(row), t))
            paths.append(path)
        return np.concatenate(rows), np.concatenate(trees), np.concatenate(paths)


def _links(threshold: float, step: int = 1024):
    """Links within one leaf of one tree whose ends share no leaf before it (of an earlier tree, or by spill of this one): each node's links by weight (b null), and edges that span what they connect."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, h, weight, chunk = (pdf[c].to_numpy(np.int64) for c in ("id", "h", "weight", "chunk"))
        across = len(np.unique(chunk)) > 1
        x, n = _unit(pdf["vec"]), len(pdf)
        # earlier cells that two of these vectors share, as a matrix of zeros and ones
        row = np.repeat(np.arange(n), [len(c) for c in pdf["earlier"]])
        _, where, times = np.unique(np.concatenate([np.asarray(c, np.int64) for c in pdf["earlier"]]), return_inverse=True, return_counts=True)
        often = times[where] > 1
        column = np.cumsum(times > 1) - 1
        degree = np.zeros(n, np.int64)
        a = b = np.empty(0, np.int64)
        for i in range(0, n, step):
            near = x[i : i + step] @ x.T >= threshold
            near[np.arange(len(near)), i + np.arange(len(near))] = False
            if across:  # pairs within a chunk have a part of their own
                near &= chunk[i : i + step, None] != chunk
            some, others = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            if often.any():
                met = np.zeros((n, int((times > 1).sum())), np.float32)
                met[row[often], column[where[often]]] = 1
                near[np.ix_(some, others)] &= met[i + some] @ met[others].T == 0
            degree[i : i + step] = near @ weight
            one, other = np.nonzero(near)
            a, b = star_edges(np.concatenate([a, ids[i + one]]), np.concatenate([b, ids[other]]))
        node = np.flatnonzero(degree)
        return pd.DataFrame({"a": np.concatenate([ids[node], a]), "b": pd.array([None] * len(node) + b.tolist(), "Int64"), "h": np.concatenate([h[node], np.zeros_like(a)]), "links": np.concatenate([degree[node], np.zeros_like(a)])})

    return links


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    trees: int = 12, leaf_rows: int = 256, spill: float = 0.01, heavy_rows: int = 2048, sample_rows: int = 20_000, max_depth: int = 18, seed: int = 7,
) -> DataFrame:
    """One row for each input row: ``id_col``, n_links, component_id, kept.

    Equal vectors of a label are one class with a weight; classes go down ``trees`` trees, each to a depth at which its label has
    about ``leaf_rows`` vectors in a leaf, with spill overlap at each split. Vectors of each length have a forest of their own; a label with so few vectors of a
    length that one leaf holds them has one tree. Classes of one label that share a leaf are
    compared in double precision; pairs at or above ``threshold`` are links, united over all trees. A link is counted in the first leaf
    that its ends share, so a leaf gives the number of links of each vector and edges that span them, never its pairs. Thresholds of the trees
    are medians over a sample of about ``sample_rows`` classes (smallest hashes of the id, all lengths together); all rows are indexed. Recall against
    brute force is measured in tests/llm. A leaf that outgrows ``heavy_rows`` (many vectors too alike to split) is
    compared in pairs of chunks.

    Vectors that are null, zero, or hold null or non-finite components, and vectors of a null label, link with nothing; vectors of
    different lengths aren't compared. n_links counts other rows, copies included; component_id is the smallest id
    reachable; kept marks it. Rows of a null id link with nothing and have null component_id. Rows repeated with one id are
    links of one another if their vectors are equal or alike, and one node of the components in any case. Other columns are not read; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(finite & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    # rows that link with nothing have keys of their own, so that they spread in the join at the end
    rows = rows.withColumn("key", F.struct(F.when(F.col("ok"), F.xxhash64("label", "vec")).otherwise(F.xxhash64("id", F.rand(seed))).alias("h"), F.when(F.col("ok"), F.xxhash64("vec", "label", F.lit(1))).alias("g")))
    classes = rows.where("ok").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.any_value("vec").alias("vec"), F.any_value("label").alias("label"))
    classes = materialise(classes.withColumn("size", F.size("vec")), "embedding")
    members = rows.select("id", "key")
    depth = F.least(F.lit(max_depth), F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / leaf_rows)))).cast("int")
    depths = materialise(classes.groupBy("size", "label").count().select(F.col("size").alias("s"), F.col("label").alias("l"), depth.alias("depth"), "count"), "embedding")
    even = classes.join(depths, (F.col("label") == F.col("l")) & (F.col("size") == F.col("s"))).select("id", "key.h", "weight", "size", "label", "depth", "vec")
    deep = depths.where("depth > 0").groupBy("s").agg(F.max("depth").alias("depth"), F.sum("count").alias("n")).collect()  # one row for each length of vectors
    steps = 1 << 30
    share = min(steps, round(steps * sample_rows / max(1, sum(r.n for r in deep))))
    sample = even.where((F.col("depth") > 0) & (F.pmod(F.xxhash64("id"), F.lit(steps)) < share)).select("size", "vec").toPandas() if deep else None
    empty = lambda n: np.zeros((1, n))
    forest = vectors.sparkSession.sparkContext.broadcast({r.s: Forest(_unit(own) if len(own := sample["vec"][sample["size"] == r.s]) else empty(r.s), trees, r.depth, seed) for r in deep})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for (size, deep), pdf in whole.groupby(["size", whole["depth"] > 0]):
                row = tree = leaf = np.arange(len(pdf))
                if deep:
                    row, tree, leaf = forest.value[size].leaves(_unit(pdf["vec"]), pdf["depth"].to_numpy(), spill)
                else:
                    tree = leaf = np.zeros(len(pdf), np.int64)
                order = np.lexsort((leaf, tree, row))
                row, tree, leaf = row[order], tree[order], leaf[order]
                cell = leaf * trees + tree  # of the label and length, which vectors that are compared have in common
                own = {c: pdf[c].to_numpy()[row] for c in ("id", "h", "weight", "size", "label", "vec")}
                yield pd.DataFrame({"tree": tree, "leaf": leaf, **own, "earlier": [cell[f:t] for t, f in enumerate(np.searchsorted(row, row).tolist())]})

    label_type = dict(even.dtypes)["label"]
    routed = even.mapInPandas(route, f"tree int, leaf bigint, id bigint, h bigint, weight bigint, size int, label {label_type}, vec array<double>, earlier array<bigint>")
    short = dict(vectors.dtypes)[vector_col] == "array<float>"
    routed = routed.select(F.xxhash64("tree", "leaf", "label", "size").alias("cell"), "label", "size", "id", "h", "weight", "earlier", F.col("vec").cast("array<float>").alias("vec") if short else "vec")
    cells = split_heavy(materialise(routed, "embedding"), "cell", heavy_rows)
    found = materialise(cells.groupBy("cell", "label", "size", "part").applyInPandas(_links(threshold), "a bigint, b bigint, h bigint, links bigint"), "embedding")
    forest.destroy()
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("node"), "h").agg(F.sum("links").alias("links")).alias("d")
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "member")
    named = classes.select("key", "id", "weight").join(degree, (F.col("id") == F.col("node")) & (F.col("key.h") == F.col("d.h")), "left").join(parts, F.col("id") == F.col("member"), "left")
    named = named.select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = members.alias("m").join(named.alias("c"), F.col("m.key") == F.col("c.key"), "left")
    component = F.coalesce("component", "m.id")
    return out.select(
        F.col("m.id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("m.id") == component, F.lit(False)).alias("kept"),
    )


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embedding_dedup`` over all of ``embeddings``."""
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

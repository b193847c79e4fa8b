"""Centroid clustering of integer vectors by filtering in partition-local ball trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .whitening import finite

#: Components as integers stay below this in absolute value, so that squared distances of up to 64 dimensions fit in 64 bits.
LARGEST = 1 << 27
#: Below this, products of up to 64 dimensions are exact in doubles and so in a matrix product.
_EXACT = 1 << 22
_TREE = "ids array<{id}>, points binary, dim int, low array<int>, high array<int>, parent array<int>, center binary, radius array<double>, sums binary"


class BallTree:
    """Balls over ``points`` (reordered): ball i holds points[low[i]:high[i]], their integer sum, a center and a radius about it. Parents stand before their children."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        n = len(points)
        order, x = np.arange(n), points.astype(float)
        self.low, self.high, self.parent, sums, centers, self.radius = [], [], [], [], [], []
        todo = [(0, n, -1)]
        while todo:
            low, high, parent = todo.pop()
            own = order[low:high]
            center = x[own].mean(axis=0)
            radius = np.sqrt(((x[own] - center) ** 2).sum(axis=1).max())
            self.low.append(low)
            self.high.append(high)
            self.parent.append(parent)
            sums.append(points[own].sum(axis=0))
            centers.append(center)
            self.radius.append(radius)
            if high - low <= leaf:
                continue
            # split along the line from the point farthest from the center to the one farthest from that
            far = x[own[((x[own] - center) ** 2).sum(axis=1).argmax()]]
            other = x[own[((x[own] - far) ** 2).sum(axis=1).argmax()]]
            if (far == other).all():  # copies of one point
                continue
            along, half = x[own] @ (other - far), (high - low) // 2
            order[low:high] = own[np.argpartition(along, half)]
            me = len(self.low) - 1
            todo += [(low + half, high, me), (low, low + half, me)]
        self.order, self.points, self.sums, self.center = order, points[order], np.stack(sums), np.stack(centers)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT and points.shape[1] <= 64:
        x, c = points.astype(float), centroids.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids.astype(np.int64)], axis=1)


def assign(tree: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster of each ball that goes whole and -1 for others, numbers of points that balls don't settle, their clusters).

    A ball goes whole if its nearest centroid is nearer, by more than the ball's diameter, than any other: by the triangle inequality that is so for each of its points, without ties.
    Below other balls the search descends; what is left at the leaves is compared exactly, ties to the smaller number.
    """
    center, radius, parent, low, high = tree["center"], tree["radius"], tree["parent"], tree["low"], tree["high"]
    away = np.sqrt(((center[:, None, :] - centroids[None, :, :].astype(float)) ** 2).sum(axis=2))
    nearest = away.argmin(axis=1)
    first = away[np.arange(len(away)), nearest]
    away[np.arange(len(away)), nearest] = np.inf
    margin = 1e-9 * (first + radius + 1)  # far above the rounding of distances
    whole = away.min(axis=1, initial=np.inf) - first > 2 * radius + margin
    ball = np.full(len(parent), -1)
    open_ball = np.zeros(len(parent), bool)
    for i in range(len(parent)):  # parents first
        if parent[i] < 0 or open_ball[parent[i]]:
            ball[i] = nearest[i] if whole[i] else -1
            open_ball[i] = not whole[i]
    inner = np.zeros(len(parent), bool)
    inner[parent[parent >= 0]] = True
    leaves = np.flatnonzero(open_ball & ~inner)
    rest = np.concatenate([np.arange(low[i], high[i]) for i in leaves]) if len(leaves) else np.empty(0, np.int64)
    return ball, rest, squared_distances(tree["points"][rest], centroids).argmin(axis=1)


def _trees(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i] for name in batch.schema.names}
        dim = row["dim"].as_py()
        tree = {k: row[k].values.to_numpy(zero_copy_only=False) for k in ("low", "high", "parent", "radius")}
        yield tree | {"ids": row.get("ids"), "points": np.frombuffer(row["points"].as_buffer(), "<i4").reshape(-1, dim), "center": np.frombuffer(row["center"].as_buffer(), "<f8").reshape(-1, dim), "sums": np.frombuffer(row["sums"].as_buffer(), "<i8").reshape(-1, dim)}


def ball_trees(vectors: DataFrame, id_type: str, tree_rows: int, leaf: int) -> DataFrame:
    """A ball tree for each ``tree_rows`` vectors (id, x array<int>) that meet in a task; rows stay where they are."""
    schema = _TREE.format(id=id_type)
    types = pa.schema([("points", pa.binary()), ("dim", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("parent", pa.list_(pa.int32())), ("center", pa.binary()), ("radius", pa.list_(pa.float64())), ("sums", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, tree_rows):
                ids, lists = batch.slice(start, tree_rows).columns
                points = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.int64)
                tree = BallTree(points, leaf)
                row = {"points": tree.points.astype("<i4").tobytes(), "dim": points.shape[1], "low": tree.low, "high": tree.high, "parent": tree.parent, "center": tree.center.tobytes(), "radius": tree.radius, "sums": tree.sums.astype("<i8").tobytes()}
                own = ids.take(pa.array(tree.order))
                own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([own, *[pa.array([row[f.name]], f.type) for f in types]], names=["ids", *types.names])

    return vectors.select("id", "x").mapInArrow(build, schema)


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """count and exact sums of the vectors nearest to each centroid: each task adds up whole balls and single points, Spark the tasks' sums. At most k rows come back."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for tree in _trees(batch):
                ball, rest, nearest = assign(tree, centroids)
                went = np.flatnonzero(ball >= 0)
                np.add.at(count, ball[went], (tree["high"] - tree["low"])[went])
                np.add.at(total, ball[went], tree["sums"][went])
                np.add.at(count, nearest, 1)
                np.add.at(total, nearest, tree["points"][rest])
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), *[pa.array(total[own, j]) for j in range(dim)]], names=["cluster", "n", *[f"s{j}" for j in range(dim)]])

    columns = ["n", *[f"s{j}" for j in range(dim)]]
    parts = trees.drop("ids").mapInArrow(add, "cluster bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns]).collect()
    return {r.cluster: (int(r.n), [int(r[c]) for c in columns[1:]]) for r in rows}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = 4096, leaf: int = 32) -> DataFrame:
    """One row for each kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dim`` components, none of them null or non-finite, as integers floor(scale * c). The k of them with the smallest sha256 of ``<seed>:<id>`` start as
    centroids. A round assigns each vector to the nearest centroid (ties: smaller number) and moves each centroid that has vectors to the floor of their mean. Ball trees are built once, within tasks, and kept in the shared folder with
    radius, count and integer sums, so that a round reads them without a shuffle: balls that lie on one side go whole, others descend to exact leaves. Only k rows of counts and sums leave a round;
    the driver holds k centroids. Copies of one vector are one ball of radius zero, so many of them cost nothing and never meet in one task.

    With fewer than k kept vectors there are as many centroids; an empty table gives an empty result. Repeated rows and ids each have a row; of equal hashes the smaller vector starts first. Vectors
    with a null id are clustered but never start a centroid (without any id to start from, no vector has a row). Equal starts stay apart: the larger number has no vectors. Other columns aren't read. An integer beyond 2^27 is an error, as
    distances then leave 64 bits; inertia is null where a long doesn't hold it.
    """
    if dim > 64:
        raise ValueError("distances are exact for up to 64 dimensions")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where((F.size("vec") == dim) & finite(F.col("vec")))
    whole = lambda c: F.when(F.abs(c) * scale < LARGEST - 1, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to cluster")).cast("bigint")).cast("int")
    rows = rows.select("id", F.transform("vec", whole).alias("x"))
    id_type = dict(rows.dtypes)["id"]
    trees = materialise(ball_trees(rows, id_type, tree_rows, leaf), "clusters")
    starts = rows.where("id IS NOT NULL").select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h")).orderBy("h", "x").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], f"{id_col} {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r.x for r in starts], np.int64)
    for _ in range(rounds):
        for c, (n, total) in _sums(trees, centroids).items():
            centroids[c] = [t // n for t in total]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in _trees(batch):
                ball, rest, nearest = assign(tree, centroids)
                own = np.empty(len(tree["points"]), np.int32)
                own[rest] = nearest
                for i in np.flatnonzero(ball >= 0):
                    own[tree["low"][i] : tree["high"][i]] = ball[i]
                distance = ((tree["points"].astype(np.int64) - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([tree["ids"].values, pa.array(own), pa.array(distance)], names=["id", "cluster", "distance"])

    result = materialise(trees.mapInArrow(last, f"id {id_type}, cluster int, distance bigint"), "clusters")
    inertia = {r.cluster: int(r.s) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    fits = lambda v: v if v < 1 << 63 else None
    each = per([fits(inertia.get(c, 0)) for c in range(len(centroids))]).cast("bigint")
    return result.select(F.col("id").alias(id_col), "cluster", "distance", each.alias("cluster_inertia"), F.lit(fits(sum(inertia.values()))).cast("bigint").alias("inertia"), per(names).alias("centroid_sha256"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster`` over all of ``embeddings``."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = 64
), starts AS (
  SELECT list(v ORDER BY h, v) AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT 8)
), rounds AS (
  SELECT 0 AS r, c FROM starts
  UNION ALL
  SELECT r + 1, [coalesce(m[k], c[k]) FOR k IN range(1, len(c) + 1)] FROM (
    SELECT r, any_value(c) AS c, map_from_entries(list((k, mean))) AS m FROM (
      SELECT r, any_value(c) AS c, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS mean FROM (
        SELECT r, any_value(c) AS c, k, i, sum(v[i]) AS s, count(*) AS n FROM (
          SELECT r, c, v, list_position(d, list_min(d)) AS k, unnest(range(1, 65)) AS i FROM (
            SELECT r, c, v, [list_sum([(v[i] - q[i]) * (v[i] - q[i]) FOR i IN range(1, 65)]) FOR q IN c] AS d FROM rounds, kept WHERE r < 10
          )
        ) GROUP BY r, k, i
      ) GROUP BY r, k
    ) GROUP BY r
  )
), final AS (
  SELECT vec_id, d, c, list_position(d, list_min(d)) AS k FROM (
    SELECT vec_id, c, [list_sum([(v[i] - q[i]) * (v[i] - q[i]) FOR i IN range(1, 65)]) FOR q IN c] AS d FROM (SELECT c FROM rounds WHERE r = 10), kept
  )
)
SELECT vec_id, (k - 1)::INT AS cluster, d[k]::BIGINT AS distance, sum(d[k]) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d[k]) OVER ()::BIGINT AS inertia, sha256(array_to_string([x::BIGINT FOR x IN c[k]], ',')) AS centroid_sha256 FROM final
"""

"""Whitening of embeddings: streamed covariance, merged over partitions, and a symmetric QR eigen-solve."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Entries of integer vectors stay below this, so that doubles hold them exactly.
LARGEST = 1 << 52
_STATE = "size int, n bigint, total array<decimal(38,0)>, mean array<double>, m2 array<double>"


class Moments:
    """Count, exact sums (of integer vectors), means and centred products of the vectors of one length."""

    def __init__(self, size: int) -> None:
        self.n, self.total, self.mean, self.m2 = 0, np.zeros(size, object), np.zeros(size), np.zeros((size, size))

    def stream(self, x: np.ndarray) -> None:
        """Welford's update for each row in turn. Row k moves the mean from m to m + (x - m) / k and adds the rank-one product (x - m) (x - m)' (k - 1) / k;
        the running means come from cumulative sums about the first mean, and the rank-one products of a batch are added by one matrix product."""
        if not len(x):
            return
        if x.dtype.kind == "i":
            narrow = len(x) * int(np.abs(x).max(initial=0)) < 1 << 63
            self.total = self.total + (x.sum(axis=0).astype(object) if narrow else x.astype(object).sum(axis=0))
        start = self.mean if self.n else x[0].astype(float)
        from_start = x - start
        k = self.n + np.arange(1, len(x) + 1)[:, None]
        running = np.cumsum(from_start, axis=0) / k  # the mean after each row, less ``start``
        moved = from_start - np.vstack([np.zeros_like(start), running[:-1]])
        moved *= np.sqrt((k - 1) / k)
        self.m2 += moved.T @ moved
        self.n, self.mean = self.n + len(x), start + running[-1]

    def merge(self, n: int, total: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        """The parallel update: the moments of two sets give those of their union."""
        if not n:
            return
        gap, both = mean - self.mean, self.n + n
        self.m2 += m2 + np.outer(gap, gap) * (self.n / both * n)
        self.mean = self.mean + gap * (n / both)
        self.total = self.total + total
        self.n = both

    def row(self, size: int) -> dict:
        return {"size": size, "n": self.n, "total": [Decimal(int(t)) for t in self.total], "mean": self.mean, "m2": self.m2.ravel()}


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors) for each length of vectors in a batch."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, _matrix(lists if len(rows) == len(lists) else lists.take(pa.array(rows)))


def moments(vectors: DataFrame, column: str, merge_tasks: int = 16) -> DataFrame:
    """One row of ``Moments`` for each length of the vectors in ``column`` (no nulls): each task streams its rows into one state for each length; states, never rows, are merged, in two steps."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        states: dict[int, Moments] = {}
        for batch in batches:
            for size, _, x in _by_size(batch, column):
                states.setdefault(size, Moments(size)).stream(x)
        for size, state in states.items():
            yield pa.RecordBatch.from_pylist([state.row(size)], schema=arrow)

    def add(states: dict[int, Moments], pdf: pd.DataFrame) -> None:
        for r in pdf.itertuples():
            states.setdefault(r.size, Moments(r.size)).merge(r.n, np.array([int(t) for t in r.total], object), np.asarray(r.mean, float), np.asarray(r.m2, float).reshape(r.size, r.size))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[int, Moments] = {}
        for pdf in batches:
            add(states, pdf)
        for size, state in states.items():
            yield pd.DataFrame([state.row(size)])

    def merge_all(pdf: pd.DataFrame) -> pd.DataFrame:
        states: dict[int, Moments] = {}
        add(states, pdf)
        return pd.DataFrame([state.row(size) for size, state in states.items()])

    decimals, doubles = pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64())
    arrow = pa.schema([("size", pa.int32()), ("n", pa.int64()), ("total", decimals), ("mean", doubles), ("m2", doubles)])
    states = vectors.select(column).mapInArrow(stream, _STATE)
    return states.repartition(merge_tasks).mapInPandas(merge, _STATE).groupBy("size").applyInPandas(merge_all, _STATE)


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the rows q with q' t q = a, by reflections."""
    a, size = a.copy(), len(a)
    q = np.eye(size)
    for k in range(size - 2):
        x = a[k + 1 :, k].copy()
        length = np.sqrt(x @ x)
        if not length:
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.sqrt(x @ x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
        q[k + 1 :] -= 2 * np.outer(x, x @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows: tridiagonal form, then implicit QR steps with Wilkinson's shift."""
    d, e, q = _tridiagonal(a)
    tiny, high = np.finfo(float).eps, len(d) - 1
    while high > 0:
        small = np.abs(e[:high]) <= tiny * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        if small[high - 1]:
            high -= 1
            continue
        low = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1], e[k] = c * c * a0 + 2 * c * s * b + s * s * a1, s * s * a0 - 2 * c * s * b + c * c * a1, c * s * (a1 - a0) + (c * c - s * s) * b
            if k + 1 < high:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    rows = q[order]
    return d[order], rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Model:
    """What whitens vectors of one length; components without variance are left out of ``scaled``."""

    def __init__(self, n: int, total: list[Decimal], m2: np.ndarray, components: int) -> None:
        self.n, self.total = n, np.array([int(t) for t in total], object)
        size = len(self.total)
        covariance = m2.reshape(size, size) / n
        values, vectors = symmetric_qr((covariance + covariance.T) / 2)
        trace = float(np.trace(covariance))
        self.shares = [float(v / trace) if trace else 0.0 for v in np.maximum(values[:components], 0)]
        self.varied = int((values[:components] > 64 * size * np.finfo(float).eps * trace).sum()) if trace else 0
        self.scaled = vectors[: self.varied].T / np.sqrt(values[: self.varied])
        self.error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where they hold it, else as Python integers."""
        wide = self.n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(self.total).max(initial=0)) >= 1 << 62
        return self.n * x.astype(object) - self.total if wide else self.n * x - self.total.astype(np.int64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(float) / self.n) @ self.scaled

    def deviations(self, centred: np.ndarray) -> list[Decimal | None]:
        """Sums of squares, exact; null where a decimal of 38 digits doesn't hold them."""
        if centred.dtype == object or np.abs(centred).max(initial=0) ** 2 * centred.shape[1] >= 1 << 62 or np.abs(centred).max(initial=0) >= 1 << 31:
            centred = centred.astype(object)
        sums = (centred * centred).sum(axis=1)
        return [Decimal(int(s)) if s < 10**38 else None for s in sums]


def _groups(models: DataFrame, components: int, most_bytes: int) -> Iterator[dict[int, Model]]:
    """The models by length, in groups whose matrices have about ``most_bytes`` bytes at most (one model at least)."""
    group, held = {}, 0
    for r in models.toLocalIterator():
        if not r.size:
            continue
        group[r.size], held = Model(r.n, r.total, np.asarray(r.m2, float), components), held + 8 * r.size * components
        if held >= most_bytes:
            yield group
            group, held = {}, 0
    if group:
        yield group


def finite(vector: Column) -> Column:
    """Whether a vector of doubles is there and holds neither nulls nor non-finite entries; never null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, model_bytes: int = 64 << 20) -> DataFrame:
    """For each usable row and principal component: ``id_col``, component (from 1), n, deviation decimal, whitened, explained, identity_error.

    Entries become integers x = floor(scale * c); a constant added to each x would cancel out of all results. The fit list is each distinct integer vector once; distinct vectors are found with a combine before the shuffle, so copies
    of one vector, however many, don't meet. Each task streams its part of the list into one state (Welford), states are merged by the parallel update formula,
    and a symmetric QR solves for the components. n is the length of the fit list, S its sums; deviation is the sum over dimensions of (n * x - S)^2,
    exact (null beyond 38 digits); whitened is (x - S / n) on the component over the root of its eigenvalue; explained is the eigenvalue's share of the trace;
    identity_error is measured: the largest entry by which the covariance of the whitened fit list is off the identity, from a second pass over it.

    The driver holds components x dimensions numbers for each length of vectors, and of many lengths ``model_bytes`` at a time; rows are never gathered.
    Rows whose vector is null or has null or non-finite entries are left out. Vectors of each length are whitened on their own; those of length zero have no
    components and so no rows. A component without variance (as when all vectors are equal) has null whitened, explained 0 and no part in identity_error. Repeated rows and ids give
    repeated results, null ids pass through, other columns aren't read, an empty table gives no rows. An entry that would leave the exact range of doubles, 2^52, is an error.
    """
    spark = vectors.sparkSession
    doubles = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), doubles.alias("vec")).where(finite(F.col("vec")))
    whole = lambda c: F.when(F.abs(c) * scale < LARGEST - 1, F.floor(c * scale)).otherwise(F.raise_error(F.lit("an entry is too large to whiten")).cast("bigint"))
    rows = rows.select("id", F.transform("vec", whole).alias("x"))
    fit = materialise(rows.select("x").distinct(), "whiten")
    id_type = dict(rows.dtypes)["id"]
    each = f"id {id_type}, n bigint, deviation decimal(38,0), identity_error double, parts array<struct<component:int,whitened:double,explained:double>>"
    empty = out = spark.createDataFrame([], each)
    for models in _groups(materialise(moments(fit, "x"), "whiten"), components, model_bytes):
        shared = spark.sparkContext.broadcast(models)

        def again(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, _, x in _by_size(batch, "x"):
                    model = shared.value.get(size)
                    if model is None:
                        continue
                    white = model.whitened(model.centred(x))
                    # the length stands before the whitened values, as several lengths may have the same number of components
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(white), pa.int32()), pa.array(list(white), pa.list_(pa.float64()))], names=["size", "w"])

        white = fit.mapInArrow(again, "size int, w array<double>")
        for size in models:  # as a rule one
            for r in moments(white.where(F.col("size") == size), "w").collect():
                k = models[size].varied
                models[size].error = float(np.abs(np.asarray(r.m2, float).reshape(k, k) / r.n - np.eye(k)).max(initial=0))
        final = spark.sparkContext.broadcast(models)

        def project(batches: Iterator[pa.RecordBatch], final=final) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for size, at, x in _by_size(batch, "x"):
                    model = final.value.get(size)
                    if model is None:
                        continue
                    centred, ids = model.centred(x), batch.column("id").take(pa.array(at))
                    white, k, total = model.whitened(centred), len(model.shares), len(x) * len(model.shares)
                    padded = pa.array(np.hstack([white, np.full((len(x), k - white.shape[1]), np.nan)]).ravel(), from_pandas=True)
                    item = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), padded, pa.array(np.tile(model.shares, len(x)))], names=["component", "whitened", "explained"])
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(0, total + 1, k, dtype=np.int32)), item)
                    columns = [ids, pa.array(np.full(len(x), model.n)), pa.array(model.deviations(centred), pa.decimal128(38, 0)), pa.array(np.full(len(x), model.error)), parts]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "deviation", "identity_error", "parts"])

        own = rows.where(F.size("x").isin(list(models))).mapInArrow(project, each)
        out = own if out is empty else out.unionByName(own)
        shared.unpersist()
    return out.select(F.col("id").alias(id_col), "n", "deviation", "identity_error", F.inline("parts")).select(id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` over all of ``embeddings``, whose integers need no offset; deviation is null where a long doesn't hold it."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("bigint"))

"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

#: Classes of bytes: lower, upper, digit, space, line end, sentence punctuation, other symbols, beyond ASCII.
_CLASSES = 8


def _byte_classes() -> np.ndarray:
    table = np.full(256, 6, np.int64)
    for kind, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?'\"()-")):
        table[list(members)] = kind
    table[128:] = 7
    return table


_TABLE = _byte_classes()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FEATURES = _CLASSES * _CLASSES + 4


def passages(text: str | None, words_each: int = 48) -> np.ndarray:
    """One row of features for each passage of ``words_each`` words: how byte classes follow one another, and word statistics. An empty text has one passage of zeros."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    raw = np.frombuffer(data, np.uint8)
    blank = _SPACE[raw]
    starts = ~blank & np.concatenate([[True], blank[:-1]])
    at = np.maximum(np.cumsum(starts) - 1, 0) // words_each
    n = int(at[-1]) + 1
    kind = _TABLE[raw]
    pairs = np.bincount((at[1:] * _CLASSES + kind[:-1]) * _CLASSES + kind[1:], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
    size = np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    more = np.empty((n, 4))
    for k in range(n):
        own = words[k * words_each : (k + 1) * words_each]
        more[k] = len(set(own)) / len(own), sum(a == b for a, b in zip(own, own[1:])) / len(own), len(own) / words_each, min(4.0, size[k, 0] / len(own) / 8)
    return np.concatenate([pairs / size, more], axis=1).astype(np.float32)


@dataclass
class Model:
    """Passage encoder, gated attention and the score of the weighted passage representation."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) * self.scale, -8, 8)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: encoded passages of all documents, one after another; first: where each document begins."""
        w = self.weights
        e = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(e @ w["V"]), 1 / (1 + np.exp(-(e @ w["U"])))
        s = (t * g) @ w["w"]
        sizes = np.diff(np.concatenate([first, [len(x)]]))
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        a = s / np.repeat(np.add.reduceat(s, first), sizes)
        z = np.add.reduceat(a[:, None] * e, first)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"e": e, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant or 0.0)
        encoded = [self.encode(b) for b in bags]
        return np.round(self.forward(np.concatenate(encoded), np.cumsum([0, *map(len, encoded[:-1])]))["p"], 9)  # the last bits depend on the batch


def gradient(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean log loss of the documents (encoded passages as for ``Model.forward``) by each weight."""
    w, f = model.weights, model.forward(x, first)
    out = (f["p"] - labels) / len(labels)
    grad = {"c": f["z"].T @ out, "d": np.array([out.sum()])}
    dz = np.repeat(out[:, None] * w["c"], f["sizes"], axis=0)
    da = (dz * f["e"]).sum(axis=1)
    ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"]))
    grad["w"] = (f["t"] * f["g"]).T @ ds
    dtg = ds[:, None] * w["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    grad["V"], grad["U"] = f["e"].T @ dt, f["e"].T @ dg
    de = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["e"] ** 2)
    grad["W"], grad["b"] = x.T @ de, de.sum(axis=0)
    return grad


def initial(mean: np.ndarray, spread: np.ndarray, hidden: int, gate: int, rng: np.random.Generator) -> Model:
    return Model(mean, 1 / np.maximum(spread, 1e-3), {
        "W": rng.normal(0, 0.15, (FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.2, (hidden, gate)), "U": rng.normal(0, 0.2, (hidden, gate)),
        "w": rng.normal(0, 0.2, gate), "c": rng.normal(0, 0.2, hidden), "d": np.zeros(1),
    })


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Learns encoder, attention and score from document labels (Adam on the log loss). Beside the bags it holds one batch at a time."""
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(labels.mean()) if len(bags) else 0.5)
    n = sum(map(len, bags))
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
    spread = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / n)
    rng = np.random.default_rng(seed)
    model = initial(mean, spread, hidden, gate, rng)
    w, first_moment, second_moment, step = model.weights, {}, {}, 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            x, first = model.encode(np.concatenate([bags[i] for i in rows])), np.cumsum([0, *(len(bags[i]) for i in rows[:-1])])
            step += 1
            for k, g in gradient(model, x, first, labels[rows]).items():
                g = g + decay * w[k]
                first_moment[k] = 0.9 * first_moment.get(k, 0) + 0.1 * g
                second_moment[k] = 0.999 * second_moment.get(k, 0) + 0.001 * g * g
                w[k] = w[k] - rate * 0.97**epoch * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train_quality(
    docs: DataFrame, labels: DataFrame, max_train: int = 8000, max_passages: int = 400_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", words_each: int = 48,
) -> Model:
    """Fits the model on at most ``max_train`` labelled documents (those with the smallest hashes of the id), never on held-out ones.

    Held out are ids whose crc32 (of the id as text) leaves 2 when divided by 4. Null labels and labels of unknown ids are passed over; without
    labels of both kinds every score is the mean label (0.5 without any). Rows that repeat an id count on their own, up to ``max_train`` in all. Documents are learned from whole; of those chosen, the
    first (by hash) with up to ``max_passages`` passages together are, and one at least, so what one task holds is bounded however long texts are. Features are made
    on all executors; one task learns from these bounded rows, and only the weights come to the driver.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL AND NOT " + HELD_OUT)
    chosen = known.distinct().orderBy(F.xxhash64("id", "y")).limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bags = [passages(t, words_each) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": pd.Series([b.tobytes() for b in bags], dtype=object)})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"h": [], "id": [], "y": [], "x": []}), *batches]).sort_values(["h", "id", "y", "x"])
        held = np.cumsum([len(x) // (4 * FEATURES) for x in got["x"]])
        got = got[(held <= max_passages) | (np.arange(len(got)) == 0)].sort_values(["id", "y", "x"])
        model = fit([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in got["x"]], got["y"].to_numpy(float))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    encoded = rows.mapInPandas(encode, "id bigint, y double, x binary")
    # as many rows as are learned from at most, which one task takes
    bounded = encoded.withColumn("h", F.xxhash64("id", "y")).orderBy("h", "x").limit(max_train)
    return pickle.loads(bounded.repartition(1).mapInPandas(learn, "model binary").first()["model"])


HELD_OUT = "pmod(crc32(cast(id AS string)), 4) = 2"


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", words_each: int = 48) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold`` on), replacing columns of these names.

    Whole texts are scored, passage by passage, in one pass without a shuffle. Null and empty texts have one empty passage and so
    all the same score; a null id isn't held out. Repeated rows and other columns pass through.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        parts = [model.scores([passages(t, words_each) for t in texts.iloc[i : i + 128]]) for i in range(0, len(texts), 128)]
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.withColumn("held_out", held).withColumn("score", score(F.col(text_col)))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model from the labels that aren't held out, and the score of every document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels)
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")

"""Byte-level BPE: ranked merges folded with higher-order functions over the bytes of distinct words, and decoding."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

_BUCKETS = 1 << 14
_NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: maps dealt by hash over an array, as a lookup in one Spark map looks at all of its keys.

    Pieces are strings with one character (of Latin-1) for each byte.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode("utf-8")) % _BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(ranks: Column, piece: Column) -> Column:
    bucket = F.get(ranks, F.pmod(F.crc32(piece), F.lit(_BUCKETS)).cast("int"))
    return F.coalesce(F.try_element_at(bucket, piece), F.lit(_NONE))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Pieces of a word: from its bytes on, each step merges the leftmost adjacent pair of the lowest rank, until none has a rank."""

    def start(pieces):
        pair = F.transform(pieces, lambda x, i: F.when(i + 1 < F.size(pieces), _rank(ranks, F.concat(x, F.get(pieces, i + 1)))).otherwise(F.lit(_NONE)))
        return F.struct(pieces.alias("p"), pair.alias("r"))

    def merge(acc, i):
        p, r = acc["p"], acc["r"]

        def with_merged(m):
            left = F.when(i > 1, F.array(_rank(ranks, F.concat(F.get(p, i - 2), m)))).otherwise(F.array().cast("array<int>"))
            right = F.when(i + 1 < F.size(p), _rank(ranks, F.concat(m, F.get(p, i + 1)))).otherwise(F.lit(_NONE))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, F.array(right), F.slice(r, i + 2, F.size(r))).alias("r"),
            )

        return _let(F.concat(F.get(p, i - 1), F.get(p, i)), with_merged)

    def step(acc, _):
        low = F.array_min(acc["r"])
        return F.when(low == _NONE, acc).otherwise(_let(F.array_position(acc["r"], low).cast("int"), lambda i: merge(acc, i)))

    pieces = F.split(F.decode(F.encode(word, "utf-8"), "iso-8859-1"), "")
    return _let(pieces, lambda ps: F.aggregate(F.slice(ps, F.lit(2), F.size(ps)), start(ps), step, lambda acc: acc["p"]))


def words_ids(words: Column, ranks: Column) -> Column:
    """Ids of each word of an array, as text with commas. The literal is bound once for the whole array."""
    one = lambda word, table: F.array_join(F.transform(fold_merges(word, table), lambda p: _rank(table, p).cast("string")), ",")
    return _let(ranks, lambda table: F.transform(words, lambda word: one(word, table)))


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a word of a few bytes: the ranks of its pairs are kept in a list, of which each merge renews two."""
    none, rank = len(ranks) + 1, ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word in n log n steps: a heap of pairs over a linked list."""
    n = len(word)
    end, back, ahead = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = ahead[i] if alive[i] else n
        if j >= n or end[j] != stop or ranks.get(word[i:stop]) != rank:
            continue
        end[i], alive[j], ahead[i] = stop, False, ahead[j]
        if ahead[i] < n:
            back[ahead[i]] = i
            if (r := ranks.get(word[i : end[ahead[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[ahead[i]]))
        if back[i] >= 0 and (r := ranks.get(word[back[i] : stop])) is not None:
            heapq.heappush(heap, (r, back[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Words(dict):
    """Packed ids by word: those of the head, and a bounded memo of others."""

    def __init__(self, head, ranks: dict[bytes, int], memo: int = 1 << 17) -> None:
        super().__init__(head)
        self.memo, self.most, self.ranks = {}, memo, ranks

    def __missing__(self, word: str) -> bytes:
        ids = self.memo.get(word)
        if ids is None:
            data = word.encode("utf-8")
            ids = np.array((merge_short if len(data) <= 48 else merge_long)(data, self.ranks), "<u4").tobytes()
            if len(self.memo) >= self.most:
                self.memo.clear()
            if len(data) <= 48:
                self.memo[word] = ids
        return ids


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", head_words: int = 1 << 17, sample_rows: int = 8192, head_bytes: int = 64,
) -> DataFrame:
    """``docs`` with ``ids_col``: the token ids of the whole text as binary, packed little-endian unsigned 32-bit.

    Each match of ``pattern`` is a word, encoded separately; there are no special tokens. The distinct words that make up most of
    the text are encoded once, by the fold of ranked merges in Spark: the ``head_words`` most frequent ones (of at most ``head_bytes`` bytes) of
    a sample of about ``sample_rows`` rows. Their table is broadcast; those two parameters bound it to a few MB. In the one pass over the
    texts a word is looked up there; one that the head lacks is merged in the same order next to its text, as folding each rare
    word in Spark costs more than the pass itself (figures in the README). What the sample holds changes the speed, never a result.
    No text is shuffled and rows stay where they are, so a source of any share of the rows does no harm.

    Null and empty texts have no ids (empty binary). Repeated rows and other columns pass through; an ``ids_col`` that exists is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = load_ranks(ranks_path)
    texts = docs.select(F.col(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 500):
                counts: dict[str, int] = {}
                for text in texts[i : i + 500]:
                    for word in find(text or ""):
                        counts[word] = counts.get(word, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    sample = texts.sample(min(1.0, sample_rows / max(1, docs.count())), seed=1)
    head = sample.mapInArrow(count_words, "word string, n bigint").where(F.octet_length("word") <= head_bytes)
    head = head.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(head_words)
    folded = words_ids(F.array("word"), rank_literal(ranks))
    head = head.repartition(spark.sparkContext.defaultParallelism * 2).select("word", F.get(folded, F.lit(0)).alias("ids")).toArrow()
    known = spark.sparkContext.broadcast((head["word"].to_pylist(), [np.array(x.split(","), "<u4").tobytes() for x in head["ids"].to_pylist()], ranks))
    keep = [c for c in docs.columns if c != ids_col]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids_col, T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        names, packed, own_ranks = known.value
        look = Words(zip(names, packed), own_ranks).__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                *others, texts = batch.slice(start, 256).columns
                out = [b"".join(map(look, find(t))) if t else b"" for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([*others, pa.array(out, pa.binary())], names=[*keep, ids_col])

    return docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text_")).mapInArrow(encode, schema)


def bpe_decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with ``bytes_col``: the pieces of the ids, joined. Null ids give null; an id without a piece is an error."""
    shared = rows.sparkSession.sparkContext.broadcast({rank: piece for piece, rank in load_ranks(ranks_path).items()})
    keep = [c for c in rows.columns if c != bytes_col]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(bytes_col, T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                *others, ids = batch.slice(start, 256).columns
                out = [None if x is None else b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([*others, pa.array(out, pa.binary())], names=[*keep, bytes_col])

    return rows.select(*[F.col(c) for c in keep], F.col(ids_col).alias("_ids_")).mapInArrow(decode, schema)


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes that they decode to). Null and empty texts have no ids and the digest of nothing; null ids and repeated rows pass through; other columns aren't read; an empty table gives no rows."""
    path, pattern = _tokenizer()
    rows = bpe_encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    rows = bpe_decode(rows, path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bpe_digests`` over all of ``documents``."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

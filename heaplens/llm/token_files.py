"""Token ids of documents in ORC files: run-length encoded stripes with row indexes and Bloom filters, in document order."""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

_SPACED = re.compile(r" (?:\s|\Z)|\s |\A ").search
#: White space but spaces and line ends.
_OTHER_SPACE = re.compile(r"[^\S \n]").search
_MARKS = ".,;:!?"


def _spaced(text: str) -> bool:
    """Whether a text has a space at either end or beside other white space."""
    if any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() else _OTHER_SPACE(text):
        return _SPACED(text) is not None
    return "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "


class Numbers(defaultdict):
    """Numbers of keys in the order in which they were first asked for."""

    def __init__(self) -> None:
        super().__init__(itertools.count().__next__)
        self.seen = 0

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def fresh(self) -> list[str]:
        """The keys asked for first since this was called last."""
        new = list(itertools.islice(reversed(self), len(self) - self.seen))[::-1]
        self.seen = len(self)
        return new


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once.

    A single space between two characters that aren't white space always begins a pre-token of a byte-level tokenizer, so texts may be cut there and the pieces encoded on their own.
    Chunks not seen before are encoded together, joined at such spaces, and told apart by how many bytes each id stands for. ``most`` bounds the chunks that are remembered.
    """

    def __init__(self, tokenizer_json: str, end_id: int | None, special_as_text: bool = True, most: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        kind = json.loads(tokenizer_json)
        pre = kind.get("pre_tokenizer") or {}
        #: only of a plain byte-level tokenizer is it known where texts may be cut
        self.cuts = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and kind.get("post_processor") is None and (special_as_text or all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in kind.get("added_tokens", [])))
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.zeros(size, np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(piece)  # a byte-level piece has one character for each byte
        for t in kind.get("added_tokens", []):
            self.bytes_of[t["id"]] = len(t["content"].encode())
        #: ids of single marks, where each is one id
        marks = [self._encode([m])[0] for m in _MARKS]
        self.marks = dict(zip(_MARKS, (m[0] for m in marks))) if all(len(m) == 1 for m in marks) else {}
        self.end, self.most = np.array([] if end_id is None else [end_id], np.int32), most
        self._forget()

    def _forget(self) -> None:
        self.known, self.length = Numbers(), 0
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keys(self, text: str) -> list[str]:
        """Keys of the chunks of a text. A chunk of a space and a piece without spaces has that piece as its key, any other chunk has itself and a space."""
        pieces = text.split(" ")
        if not _spaced(text):
            pieces[0] += " "
            return pieces
        out: list[str] = []  # chunks; pieces at spaces that stand beside other white space stay together
        open_end = True
        for k, piece in enumerate(pieces):
            if k and not open_end and piece and not piece[0].isspace():
                out.append(" " + piece)
            elif k:
                out[-1] += " " + piece
            else:
                out.append(piece)
            open_end = not piece or piece[-1].isspace()
        return [c + " " if not k or " " in c[1:] else c[1:] for k, c in enumerate(out)]

    def _learn(self) -> None:
        """Ids of the chunks that have a number but no ids yet."""
        keys = self.known.fresh()
        # a letter run and one mark behind it, in plain ASCII, are two pre-tokens, of which the mark is one id
        marked = [k for k in keys if len(k) > 1 and k[-1] in _MARKS and k.isascii() and k[:-1].isalpha()] if self.marks else []
        if marked:
            rest = set(marked)
            keys = [k for k in keys if k not in rest]
            bases = self.known.of([k[:-1] for k in marked])  # new ones count as fresh
            keys += self.known.fresh()
        room = len(self.known) - len(self.sizes)
        self.starts, self.sizes = np.append(self.starts, np.zeros(room, np.int64)), np.append(self.sizes, np.zeros(room, np.int64))
        # a joined text may be cut at chunks whose last character isn't white space, which the next chunk's space follows
        plain = [k for k in keys if not k[-1].isspace()]
        others = [k for k in keys if k[-1].isspace()] if len(plain) < len(keys) else []
        found = []
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            joined = " " + " ".join(some)
            own = np.array(self._encode([joined])[0], np.int32)
            # no chunk of these has a space of its own, so the next space is its end
            ends = np.append(np.flatnonzero(np.frombuffer(joined.encode(), np.uint8) == 32)[1:], len(joined.encode()))
            cut = np.searchsorted(np.cumsum(self.bytes_of[own]), ends) + 1  # the ids up to the end of each chunk
            found.append((own, np.diff(cut, prepend=0)))
        if others:
            own = self._encode([k[:-1] if k[-1] == " " else " " + k for k in others])
            found.append((np.array([i for x in own for i in x], np.int32), np.array([len(x) for x in own])))
        if found:
            self._add(self.known.of(plain + others), np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))
        if marked:
            ids, sizes = self._gather(bases)
            self._add(self.known.of(marked), np.insert(ids, np.cumsum(sizes), [self.marks[k[-1]] for k in marked]), sizes + 1)

    def _add(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts[at], self.sizes[at] = self.length + np.cumsum(sizes) - sizes, sizes
        self.flat = np.append(self.flat, ids.astype(np.int32, copy=False))
        self.length += len(ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of known chunks one after another, how many each has)."""
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[at] - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; how many each text has)."""
        if not self.cuts:
            ids = [np.concatenate([np.array(x, np.int32), self.end]) for x in self._encode([t or "" for t in texts])]
            return np.concatenate(ids or [self.end[:0]]), np.array([len(x) for x in ids], np.int64)
        if len(self.known) > self.most:
            self._forget()
        keys: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = self._keys(text)
                counts[i] = len(own)
                keys += own
        at = self.known.of(keys)
        if len(self.known) > self.known.seen:
            self._learn()
        ids, sizes = self._gather(at)
        ends = np.cumsum(counts)
        per_text = np.diff(np.append(0, np.cumsum(sizes))[ends], prepend=0) if len(texts) else counts
        if len(self.end):
            ids = np.insert(ids, np.cumsum(per_text), self.end[0])
        return ids, per_text + len(self.end)


_encoders: dict[tuple, ChunkEncoder] = {}


def _encoder(*args) -> ChunkEncoder:
    """This worker's encoder, which keeps what it knows from task to task."""
    if args not in _encoders:
        _encoders.clear()
        _encoders[args] = ChunkEncoder(*args)
    return _encoders[args]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, index_rows: int = 1000, bloom_fpp: float = 0.01, special_as_text: bool = True,
) -> None:
    """Write the token ids of ``docs`` to ``folder``, in ascending order of ``id_col``, as ``files`` (ORC) and ``index``.

    ``files`` has a row for each document: part, doc_id, offset (ids of the documents before it in its part), n_tokens, ids. ORC keeps integers run-length encoded in stripes of about ``stripe_bytes``, with minima and maxima for each ``index_rows`` rows
    and Bloom filters on the document id, so that a reader of some ids skips files, stripes and row groups, and a reader of all takes stripes side by side. ``index`` has a row for each part: part, tokens, docs, base (ids of all parts before it).

    Texts are dealt by ranges of the id and encoded whole where they are sorted, in one pass; what is summed up afterwards is one number for each part. Null texts count as empty; each document's ids end with ``end_id`` (if given). Null ids come first; of equal ids the order
    is by a hash of the text, then by where a row was read, so a repeated id may be as frequent as it likes and is still dealt to many tasks. Strings of special tokens within a text are ordinary text (``special_as_text``).
    Other columns aren't read. An empty table gives empty files.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary, some MB whatever the corpus
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, offset, part = _encoder(shared.value, end_id, special_as_text), 0, TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, texts = batch.slice(start, 256).columns
                tokens, sizes = encoder.encode(texts.to_pylist())
                stops = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(tokens))
                columns = [pa.array(np.full(len(sizes), part, np.int64)), ids, pa.array(offset + stops - sizes), pa.array(sizes), lists]
                offset += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "offset", "n_tokens", "ids"])

    tokens = rows.select("doc_id", "text").mapInArrow(encode, f"part bigint, doc_id {id_type}, offset bigint, n_tokens bigint, ids array<int>")
    orc = {"orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_fpp, "orc.compress": "LZ4"}  # packed integers leave little for a slower codec
    tokens.write.options(**orc).orc(f"{folder}/files")
    parts = spark.read.orc(f"{folder}/files").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # running sums over one row for each part: pairs of parts, a number each
    parts = parts.withColumn("base", F.expr("sum(tokens) OVER (ORDER BY part) - tokens"))
    parts.select("part", "first", "last", "docs", "tokens", "base").write.parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of files by ``write_tokens``: doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id reach the files' statistics and Bloom filters; columns that aren't asked for aren't read."""
    files = spark.read.orc(f"{folder}/files")
    return files.join(spark.read.parquet(f"{folder}/index").select("part", "base"), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """``rows`` with ids replaced by ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, packed."""
    kept = [c for c in rows.columns if c != "ids"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(check, ", ".join([*[f"{c} {types[c]}" for c in kept], "ids_crc32 bigint"]))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all of ``documents`` to files in the shared folder and tells each document's place, number and crc32 from them."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return ids_crc32(read_tokens(spark, folder))

"""Suffix-array dedup: bytes covered by a long string that occurs earlier in the corpus are removed, the first copy stays."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Windows handled at a time, so that the arrays for a very long text stay small.
_SEGMENT = 1 << 20
_POSITION_BITS = 21
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _gram_hashes(data: np.ndarray, log_width: int) -> np.ndarray:
    """64-bit hashes of all 2**log_width-byte strings, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIERS[0])
    for level in range(log_width):
        half = 1 << level
        a, b = h[:-half], h[half:]
        h = (a ^ (a >> np.uint64(29))) * np.uint64(_MULTIPLIERS[1 + level % 5]) + (b ^ (b >> np.uint64(32))) * np.uint64(_MULTIPLIERS[0])
        h ^= h >> np.uint64(31)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, m = 1, x
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    return m


def anchors(data: bytes, length: int, log_gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals all ``length``-byte windows of a text to anchors: (gram hash, first window, number of windows) for each anchor.

    A window's anchor is its leftmost gram of the smallest hash, so equal windows have equal anchors at equal
    offsets wherever they stand, and the windows of one anchor follow each other.
    """
    out, gram = [], 1 << log_gram
    for at in range(0, len(data) - length + 1, _SEGMENT):
        piece = np.frombuffer(data, np.uint8, min(len(data) - at, _SEGMENT + length - 1), at)
        h = _gram_hashes(piece, log_gram)
        order = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
        low = _sliding_min(order, length - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        where = (low[first] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        out.append((h[where].view(np.int64), first + at, np.diff(np.concatenate([first, [len(low)]]))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def lpf_at_least(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the spans, taken in order of position, have a longest previous factor of at least ``length``: (flags, windows of each span).

    The suffixes of all spans that are long enough are put in suffix order (on their first ``length`` bytes, as more isn't
    asked). A run of suffixes whose common prefixes reach ``length`` holds the nearest smaller positions before and after each of
    its members; a suffix has such an earlier match if either exists, that is, if it isn't the run's smallest position.
    """
    count = np.array([max(0, len(s) - length + 1) for s in spans], np.int64)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.frombuffer(s, np.uint8), length) for s, n in zip(spans, count) if n] or [np.empty((0, length), np.uint8)])
    text = np.ascontiguousarray(windows).view(f"S{length}").ravel() if len(windows) else np.empty(0, f"S{length}")
    suffixes = np.argsort(text, kind="stable")
    same = text[suffixes[1:]] == text[suffixes[:-1]]
    # positions rise within a run, as the sort is stable: the previous smaller position is the neighbour before
    earlier = np.zeros(len(text), bool)
    earlier[suffixes[1:][same]] = True
    return earlier, count


def covered_windows(spans: pd.DataFrame, length: int) -> pd.DataFrame:
    """Ranges (id, tag, lo, hi) of the windows of ``spans`` (id, tag, lo, bytes) that occur earlier among them, runs of windows in one."""
    # rows repeated in full have equal spans; a first window belongs to one span of its document
    spans = spans.drop_duplicates(["id", "tag", "lo"]).sort_values(["id", "tag", "lo"])
    flags, count = lpf_at_least(list(spans["bytes"]), length)
    own = np.repeat(np.arange(len(spans)), count)
    at = np.flatnonzero(flags)
    if not len(at):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("id", "tag", "lo", "hi")})
    new = np.concatenate([[True], (np.diff(at) > 1) | (own[at[1:]] != own[at[:-1]])])
    first, last = at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    k, begin = own[first], np.cumsum(count) - count
    lo = spans["lo"].to_numpy()[k]
    return pd.DataFrame({"id": spans["id"].to_numpy()[k], "tag": spans["tag"].to_numpy()[k], "lo": lo + first - begin[k], "hi": lo + last - begin[k] + length})


def merged(ranges: np.ndarray) -> np.ndarray:
    """Union of half-open ranges as sorted, separate ranges (touching ones joined)."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([ranges[first, 0], np.concatenate([reach[first[1:] - 1], reach[-1:]])], axis=1)


def _packed(docs: DataFrame) -> DataFrame:
    """id, tag, data: the text's bytes compressed, as texts travel twice between executors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([pa.compress(t.encode("utf-8"), "zstd", asbytes=True) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pc.binary_length(batch.column(2)), pa.int64()), texts], names=["id", "tag", "size", "data"])

    return docs.select("id", "tag", "text").mapInArrow(pack, "id bigint, tag bigint, size bigint, data binary")


def _unpack(size: int, data: bytes) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def repeated_ranges(docs: DataFrame, packed: DataFrame, length: int = 100, log_gram: int = 5, heavy_spans: int = 20_000, bucket_spans: int = 4096) -> DataFrame:
    """``id``, ``tag``, ``lo``, ``hi``: byte ranges of ``docs`` (id, tag, text) whose windows of ``length`` bytes occur earlier.

    Every window belongs to one anchor (see ``anchors``), and equal windows to equal anchors, so only anchors whose gram occurs
    again need a look. An anchor and its windows are one span of fewer than 2 * ``length`` bytes. Spans are ranged by (gram, span)
    and sorted, so a gram of any frequency may lie in several tasks; repeats within one batch of documents are known before and only pass
    through, dealt evenly. Spans of rows repeated in full are one span. Of equal spans all but the first are repeats. Of a gram with different spans (at the edges of shared passages), and of the grams at
    the ends of a task's range, the first of each span goes on as an edge.

    Edges get their bytes and are dealt by gram into buckets of about ``bucket_spans``, where the longest previous factors of their
    suffixes decide each window. A gram with more than ``heavy_spans`` different spans (about 140 MB of suffixes) is dealt by window
    instead: a run in suffix order is then a group, and its smallest position a grouped minimum.
    """
    key = "id bigint, tag bigint"
    names = ["h", "span", "id", "tag", "lo", "n", "again"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                cols, met = [], set()
                for i, t, text in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns)):
                    data = text.encode("utf-8")
                    row = (i, t, digest(data))
                    if row in met:
                        continue  # repeated in full: one document
                    met.add(row)
                    h, lo, n = anchors(data, length, log_gram)
                    if len(h):
                        span = np.array([digest(data[a:b]) for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())], np.uint64).view(np.int64)
                        cols.append((h, span, np.full(len(h), i), np.full(len(h), t), lo, n))
                if cols:
                    h, span, i, t, lo, n = (np.concatenate(x) for x in zip(*cols))
                    order = np.lexsort((lo, t, i, span, h))
                    h, span, i, t, lo, n = (x[order] for x in (h, span, i, t, lo, n))
                    again = np.concatenate([[False], (h[1:] == h[:-1]) & (span[1:] == span[:-1])])
                    new = ~again
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[new], span[new], i[new], t[new], lo[new], n[new], again[new])], names=names)
                    i, t, lo, n = _joined(*(x[again] for x in (i, t, lo, n)))
                    h = ((i.astype(np.uint64) ^ lo.astype(np.uint64) << np.uint64(20)) * np.uint64(_MULTIPLIERS[0])).view(np.int64)  # anywhere
                    span, again = np.zeros(len(i), np.int64), np.ones(len(i), bool)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, span, i, t, lo, n, again)], names=names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted spans to copies (h null) and edges. Between batches it holds two rows."""
        held, last, seen, mixed = None, None, None, True  # held: the only span so far of the gram at hand; mixed: it has more, or may have in the task before
        for batch in batches:
            if not batch.num_rows:
                continue
            h, span, i, t, lo, n, again = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield from _emit([(None, i[again], t[again], lo[again], n[again])])
            if again.all():
                continue
            spans = np.stack([x[~again] for x in (h, span, i, t, lo, n)])
            # rows repeated in full have sent the same spans, which stand side by side
            spans = spans[:, np.concatenate([[seen is None or (spans[:5, 0] != seen).any()], (spans[:5, 1:] != spans[:5, :-1]).any(axis=0)])]
            if not spans.shape[1]:
                continue
            seen = spans[:5, -1]
            h, span, i, t, lo, n = spans
            fresh_h = np.concatenate([[last is None or h[0] != last[0]], h[1:] != h[:-1]])
            fresh = fresh_h | np.concatenate([[last is None or span[0] != last[1]], span[1:] != span[:-1]])
            rows = np.flatnonzero(fresh)
            group = np.cumsum(fresh_h) - (0 if not fresh_h[0] else 1)  # grams of this batch; 0 is the held one if it goes on
            goes_on = last is not None and not fresh_h[0]
            spans_of = np.bincount(group[rows], minlength=int(group[-1]) + 1)
            edge_group = spans_of > 1
            out = [(None, i[~fresh], t[~fresh], lo[~fresh], n[~fresh])]
            if goes_on:
                edge_group[0] = mixed or spans_of[0] > 0
                if held is not None and spans_of[0] > 0:
                    out.append(tuple(np.array([x]) for x in held))
                    held = None
            else:
                if last is None:
                    edge_group[0] = True  # the task before may have had the same gram
                held = None
            end = int(group[-1])
            final = edge_group.copy()
            if not (goes_on and end == 0):
                mixed = bool(edge_group[end])
                alone = rows[group[rows] == end]
                if not mixed and len(alone) == 1:
                    k = alone[0]
                    held = (h[k], i[k], t[k], lo[k], n[k])
            else:
                mixed = bool(edge_group[0])
            pick = rows[final[group[rows]]]
            out.append((h[pick], i[pick], t[pick], lo[pick], n[pick]))
            last = (h[-1], span[-1])
            yield from _emit(out)
        if held is not None:
            yield from _emit([tuple(np.array([x]) for x in held)])

    def _joined(i, t, lo, n):
        """Spans of a document that follow each other as one."""
        order = np.lexsort((lo, t, i))
        i, t, lo, n = (x[order] for x in (i, t, lo, n))
        if not len(i):
            return i, t, lo, n
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (lo[1:] != lo[:-1] + n[:-1])]))
        return i[new], t[new], lo[new], np.add.reduceat(n, new)

    def _emit(parts) -> Iterator[pa.RecordBatch]:
        for h, *rest in parts:
            if len(rest[0]):
                grams = pa.nulls(len(rest[0]), pa.int64()) if h is None else pa.array(h, pa.int64())
                yield pa.RecordBatch.from_arrays([grams, *[pa.array(x, pa.int64()) for x in rest]], names=["h", "id", "tag", "lo", "n"])

    found = docs.select("id", "tag", "text").mapInArrow(find, f"h bigint, span bigint, {key}, lo bigint, n bigint, again boolean")
    ranged = found.repartitionByRange("h", "span").sortWithinPartitions("h", "span", "id", "tag", "lo")
    rows = materialise(ranged.mapInArrow(part, f"h bigint, {key}, lo bigint, n bigint"), "substrings")
    copies = rows.where("h IS NULL").select("id", "tag", "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi"))

    edges = rows.where("h IS NOT NULL")
    mixed = edges.groupBy("h").count().where("count > 1")
    wanted = edges.join(mixed, "h").select("id", "tag", F.struct("h", "lo", "n", (F.col("count") > heavy_spans).alias("heavy")).alias("s")).groupBy("id", "tag").agg(F.collect_list("s").alias("spans"))
    wanted = packed.join(wanted, ["id", "tag"]).select("id", "tag", "size", "data", *[F.col(f"spans.{c}").alias(c) for c in ("h", "lo", "n", "heavy")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, tags, sizes, datas, *lists = (c.to_pylist() for c in batch.slice(start, 256).columns)
                out: list[list] = [[], [], [], [], [], []]
                for i, t, size, data, *items in zip(ids, tags, sizes, datas, *lists):
                    data = _unpack(size, data)
                    for h, lo, n, heavy in zip(*items):
                        for to, x in zip(out, (h, i, t, lo, heavy, data[lo : lo + n - 1 + length])):
                            to.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["h", "id", "tag", "lo", "heavy", "bytes"])

    edge = materialise(wanted.mapInArrow(cut, f"h bigint, {key}, lo bigint, heavy boolean, bytes binary"), "substrings")
    buckets = max(1, edge.count() // bucket_spans)
    by_gram = edge.where("NOT heavy").withColumn("bucket", F.pmod("h", F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: covered_windows(pdf, length), f"{key}, lo bigint, hi bigint")
    windows = edge.where("heavy").select("id", "tag", "lo", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("k"))
    windows = windows.select("id", "tag", (F.col("lo") + F.col("k")).alias("lo"), F.substring("bytes", F.col("k") + 1, F.lit(length)).alias("w"))
    windows = windows.select("id", "tag", "lo", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(1), "w").alias("w2"))
    runs = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "tag", "lo")).alias("first"), F.count("*").alias("c")).where("c > 1")
    by_window = windows.join(runs, ["w1", "w2"]).where(F.struct("id", "tag", "lo") != F.col("first")).select("id", "tag", "lo", (F.col("lo") + length).alias("hi"))
    return copies.unionAll(by_gram).unionAll(by_window)


def substring_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id_col``, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    A byte goes if it is covered by a string of ``length`` bytes (UTF-8) that also starts earlier: in a document of a smaller id, or
    in the same document. Strings don't cross documents; they are judged on the input, not on what is left.

    Null texts count as empty. A null id is smaller than any other. Rows that repeat an id with another text are separate documents, ordered
    by a checksum of the text; rows repeated in full are one document and give equal rows. Other columns are not read; an
    empty table gives an empty result. One row's text and ranges are in memory at a time.
    """
    lowest = -(2**63)
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("id"), F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("bigint").alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = _packed(base)
    ranges = repeated_ranges(base.where(F.octet_length("text") >= length), packed, length)
    ranges = ranges.groupBy("id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    key_type = dict(docs.dtypes)[id_col]
    key = F.when(F.col("id") != lowest, F.col("id")).cast(key_type).alias("key")
    rows = packed.join(ranges, ["id", "tag"], "left").select(key, "size", "data", F.transform("ranges", lambda r: r["lo"]).alias("lo"), F.transform("ranges", lambda r: r["hi"]).alias("hi"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for size, data, lo, hi in zip(*(c.to_pylist() for c in part.columns[1:])):
                    data = _unpack(size, data)
                    gone = merged(np.array([lo or [], hi or []], np.int64).T)
                    keep = np.concatenate([[0], gone.ravel(), [len(data)]])
                    left = b"".join(data[a:b] for a, b in zip(keep[::2].tolist(), keep[1::2].tolist()))
                    out.append((len(data), len(data) - len(left), len(gone), left))
                sizes = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *sizes, pa.array([x[3] for x in out], pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.mapInArrow(remove, f"key {key_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("key", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``substring_dedup`` over all of ``documents``, with the digest of what stays."""
    rows = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

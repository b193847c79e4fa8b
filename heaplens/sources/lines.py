"""Log lines of files as a table, with an order within each file."""

from __future__ import annotations

import bz2
import datetime
import functools
import gzip
import io
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .globs import MAX_DEPTH, Glob, Visible, expand, strip_scheme

#: path, host, split and pos give the order of lines within a path: by split, then by pos.
LINE_SCHEMA = "path string, host string, split bigint, pos bigint, line string"


_LISTED = "path string, length bigint, modified timestamp, real string"

#: The driver walks down until this many folders wait; those and what is below them are dealt to tasks.
WIDE = 256


def _listed_remote(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, length, modified of all files at or below ``roots``; roots without any are passed over."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(roots)
        return files.select("path", "length", F.col("modificationTime").alias("modified"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if len(roots) > 1:
            return functools.reduce(DataFrame.unionByName, [_listed_remote(spark, [r]) for r in roots])
        return spark.createDataFrame([], "path string, length bigint, modified timestamp")


def _is_local(spark: SparkSession, pattern: str) -> bool:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):/", pattern)
    return scheme[1] == "file" if scheme else pattern.startswith("/") and (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")


def _told(files: list[os.DirEntry]) -> Iterator[tuple[str, int, int, str]]:
    """path, length, time in microseconds (whole milliseconds, as Spark has them) and canonical path of files in one folder; empty ones, those that are gone and those whose name is no UTF-8 are passed over."""
    folder = os.path.realpath(os.path.dirname(files[0].path)) if files else ""
    for entry in files:
        try:
            s = entry.stat()
            if s.st_size and entry.path.encode("utf-8", "ignore") == os.fsencode(entry.path):
                yield entry.path, s.st_size, s.st_mtime_ns // 1_000_000 * 1000, os.path.realpath(entry.path) if entry.is_symlink() else os.path.join(folder, entry.name)
        except FileNotFoundError:
            continue


def _spread(rows: DataFrame, count: int, size: int = 0) -> DataFrame:
    """Small rows that stand for much work (of so many bytes), dealt to all cores several times over."""
    return rows.repartition(max(1, min(count, max(4 * rows.sparkSession.sparkContext.defaultParallelism, count // 500, size // (4 * BLOCK)))))


def _listed_local(spark: SparkSession, globs: list[Glob]) -> DataFrame:
    """As ``_listed``, of local files: the driver walks through the first levels, tasks through the others."""
    seen = Visible(globs)
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("micros", pa.int64()), ("real", pa.string())])
    table = lambda rows: pa.table([list(x) for x in zip(*rows)] or [[], [], [], []], schema=schema)
    found, todo = [], [(base, 0, ()) for base in seen.bases()]
    while todo and len(todo) < WIDE:
        looked = [seen.look(*folder) for folder in todo]
        found += [row for files, _ in looked for row in _told(files)]
        todo = [folder for _, below in looked for folder in below]
    kinds = "path string, length bigint, micros bigint, real string"
    out = spark.createDataFrame(table(found)) if found else spark.createDataFrame([], kinds)
    if todo:

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                folders = [(r["path"], r["depth"], tuple(tuple(x) for x in r["above"])) for r in batch.to_pylist()]
                rows = []
                while folders:
                    files, below = seen.look(*folders.pop())
                    rows += _told(files)
                    folders += below
                    if len(rows) >= 10_000:
                        yield from table(rows).to_batches()
                        rows = []
                yield from table(rows).to_batches()

        waiting = pa.table({"path": [x[0] for x in todo], "depth": [x[1] for x in todo], "above": pa.array([[list(p) for p in x[2]] for x in todo], pa.list_(pa.list_(pa.int64())))})
        out = out.unionByName(_spread(spark.createDataFrame(waiting), len(todo)).mapInArrow(go_on, kinds))
    return out.select("path", "length", F.timestamp_micros("micros").alias("modified"), "real")


def _listed(spark: SparkSession, globs: list[Glob]) -> DataFrame:
    """path, length, modified, real (the canonical path) of all files that match one of the patterns, which have no braces."""
    local, remote = [g for g in globs if _is_local(spark, g.pattern)], [g for g in globs if not _is_local(spark, g.pattern)]
    out = _listed_local(spark, local) if local else spark.createDataFrame([], _LISTED)
    if not remote:
        return out
    files = _listed_remote(spark, sorted({r for g in remote for r in g.roots()})).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?(?=/)", "")
    levels = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))
    bases = [strip_scheme(b) for g in remote for b in g.bases]
    near = functools.reduce(lambda x, y: x | y, [bare.startswith(b) & (levels < b.count("/") + MAX_DEPTH) for b in dict.fromkeys(bases)])
    files = files.where(bare.rlike("^(?:" + "|".join(g.text for g in remote) + ")$") & near)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(real=[os.path.realpath(p) if p.startswith("/") else p for p in pdf["path"]])

    files = files.mapInPandas(resolve, _LISTED)
    return out.unionByName(files) if local else files


def list_files(spark: SparkSession, patterns: list[str] | str) -> DataFrame:
    """path, length, modified of all files that match any of the glob patterns (see ``Glob``), each file once. Contents are not read.

    Patterns may overlap or repeat, and links may lead to a file on several ways: local files are told apart by their canonical path, and of several paths the one that is no link, else the smallest, stays. Local paths have no scheme,
    others are as Spark writes them. Local folders are walked, by the driver until there are enough to deal to tasks, then by these; of others Spark lists what is below each pattern's first ``**``. Names that begin with ``_`` or ``.`` are hidden (of folders from a pattern's first ``**`` on), and empty files, which have no lines, aren't listed.
    """
    globs = [Glob(alone) for p in ([patterns] if isinstance(patterns, str) else patterns) for alone in expand(p)]
    if not globs:
        return spark.createDataFrame([], "path string, length bigint, modified timestamp")
    best = _listed(spark, globs).groupBy("real").agg(F.min(F.struct(F.col("path") != F.col("real"), "path", "length", "modified")).alias("f"))
    return best.select("f.path", "f.length", "f.modified")


def match_names(files: DataFrame, directory: str, regex: str) -> DataFrame:
    """Files that stand directly in ``directory`` and whose whole name matches ``regex``."""
    parent = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), r"/[^/]*$", "")
    return files.where((parent == directory.rstrip("/")) & F.regexp_extract("path", r"([^/]*)$", 1).rlike(f"^(?:{regex})$"))


def admit(files: DataFrame, now: datetime.datetime, idle_ms: int = 3_600_000, opened: DataFrame | None = None, quarantine: DataFrame | None = None, quarantine_ms: int = 3_600_000) -> DataFrame:
    """Files to open: not idle for longer than ``idle_ms``, not open yet, and not put in ``quarantine`` (path, since) within ``quarantine_ms``."""
    at = F.lit(now)
    files = files.where(F.col("modified") + F.make_dt_interval(secs=F.lit(idle_ms / 1000)) >= at)
    if opened is not None:
        files = files.join(opened.select("path"), "path", "left_anti")
    if quarantine is not None:
        files = files.join(quarantine.where(F.col("since") + F.make_dt_interval(secs=F.lit(quarantine_ms / 1000)) > at).select("path"), "path", "left_anti")
    return files


def _escaped(path: str) -> str:
    """A path for a reader that takes patterns."""
    return ("file://" if path.startswith("/") else "") + re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def lines_of(spark: SparkSession, paths: list[str], host: str = "localhost") -> DataFrame:
    """All lines of the files with these paths, as (path, host, split, pos, line); see ``read_lines``."""
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    lines = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).text([_escaped(p) for p in paths])
    # the name is given as part of a URL
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    return lines.select(path.alias("path"), F.lit(host).alias("host"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


#: Local files are read in blocks of this many bytes, and lines are handed over in rows of at most this many.
BLOCK, ROWS = 16 << 20, 4096
#: What Spark's reader unpacks by its name.
_PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
_BOM = b"\xef\xbb\xbf"
_KINDS = "path string, split bigint, first bigint, lines array<string>"


def _cut(data: bytes) -> list[bytes]:
    """Lines, and what follows the last line's end (nothing, if that ends the data)."""
    return (data.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if b"\r" in data else data).split(b"\n")


def _block(path: str, begin: int, end: int) -> list[bytes]:
    """The lines of a local file that begin at ``begin`` or after, and before ``end``; one that goes on beyond that is read to its end."""
    with open(path, "rb") as f:
        # a line begins where another ends: the byte before tells whether one begins with the block
        f.seek(max(begin - 1, 0))
        data = f.read(end - f.tell())
        lines = _cut(data.removeprefix(_BOM) if not begin else data)
        if begin:
            del lines[0]
        if lines and lines[-1]:
            rest = [lines[-1]]
            while (more := f.read(1 << 16)) and not (b"\n" in more or b"\r" in more):
                rest.append(more)
            lines[-1] = b"".join([*rest, _cut(more)[0]])
        elif lines:
            del lines[-1]
    return lines


def _rows(path: str, split: int, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(lines), ROWS):
        own = pa.array(lines[first : first + ROWS], pa.binary()).view(pa.string())  # bytes as they are, as Spark's reader has them
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([split]), pa.array([first]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["path", "split", "first", "lines"])


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += batch.nbytes
        if held >= size:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def _as_lines(rows: DataFrame, host: str) -> DataFrame:
    told = rows.select("path", "split", "first", F.posexplode("lines").alias("k", "line"))
    return told.select("path", F.lit(host).alias("host"), "split", (F.col("first") + F.col("k")).alias("pos"), "line")


def lines_in(files: DataFrame, host: str = "localhost") -> DataFrame:
    """All lines of files as from ``list_files`` (which should be kept, as they are read several times), as (path, host, split, pos, line); see ``read_lines``."""
    plain = F.col("path").startswith("/") & ~F.col("path").rlike(_PACKED)
    packed = [r.path for r in files.where(~plain).select("path").collect()]
    others = lines_of(files.sparkSession, packed, host)
    blocks = files.where(plain).select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(BLOCK).cast("bigint"))).alias("split"))
    count, size = blocks.agg(F.count("*"), F.sum(F.least(F.col("length") - F.col("split"), F.lit(BLOCK)))).first()
    if not count:
        return others

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    try:
                        lines = _block(row["path"], row["split"], min(row["length"], row["split"] + BLOCK))
                    except OSError:
                        continue
                    yield from _rows(row["path"], row["split"], lines)

        return _gathered(each())

    own = _as_lines(_spread(blocks, count, size).mapInArrow(read, _KINDS), host)
    return own.unionByName(others) if packed else own


def read_lines(spark: SparkSession, patterns: list[str] | str, host: str = "localhost", modified_after: str | None = None) -> DataFrame:
    """All lines of the files that match, as (path, host, split, pos, line).

    Patterns are resolved to a list of files first (see ``list_files``), so that a file that several patterns or links lead to is read once.
    Files are split by blocks, so one file of any size is read by many tasks: plain local files are opened by tasks, each with many files of the list, and their list never is on the driver; packed and remote files are read as any text table. ``split`` is where the block begins,
    ``pos`` grows within it. Lines end at LF, CR or CRLF; a last line without an end counts. Files that vanish or can't be read are
    passed over; ``probe_files`` tells which.
    """
    files = list_files(spark, patterns)
    if modified_after:
        files = files.where(F.col("modified") > F.lit(modified_after).cast("timestamp"))
    return lines_in(files.localCheckpoint(), host)


def _head(path: str, count: int, max_line: int, whole: bool = False) -> list[str]:
    """The first ``count`` lines of a local file, or those up to the first one of over ``max_line`` characters. Reads ``count`` times ``max_line`` characters at most, however large the file is."""
    opened = {".gz": gzip.open, ".bz2": bz2.open}.get(os.path.splitext(path)[1], open)
    lines: list[str] = []
    with opened(path, "rb") as raw, io.TextIOWrapper(raw, "utf-8", "replace", newline=None) as f:
        while len(lines) < count and (line := f.readline(max_line + 2)):
            lines.append(line.removesuffix("\n"))
            if len(lines[-1]) > max_line:
                break
        while whole and opened is not open and f.read(1 << 20):
            pass
    return lines


def probe_files(files: DataFrame, host: str = "localhost", count: int = 512, max_line: int = 1024, whole: bool = False) -> DataFrame:
    """One row for each file of ``list_files``: path, host, length, modified, error, head.

    head has the first ``count`` lines, less what follows a line of over ``max_line`` characters, which comes as its first ``max_line`` + 1 or 2. Tasks read no more of a file than that. error tells why
    a file can't be read (it is unreadable, gone, or its compression is broken; with ``whole`` compressed files are read to their end to see that); then head is null. Nothing stops the others. Only local files are opened; of others head is null without an error.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    rows.append((None, _head(path, count, max_line, whole) if path.startswith("/") else None))
                except (OSError, EOFError, zlib.error) as error:
                    rows.append((f"{type(error).__name__}: {error}", None))
            yield pdf.assign(host=host, error=[r[0] for r in rows], head=[r[1] for r in rows])[["path", "host", "length", "modified", "error", "head"]]

    return files.mapInPandas(probe, "path string, host string, length bigint, modified timestamp, error string, head array<string>")


def read_heads(spark: SparkSession, patterns: list[str] | str, host: str = "localhost", count: int = 512, max_line: int = 1024) -> DataFrame:
    """The first lines of the files that match, in the form of ``read_lines``: what the diary needs. Local files are opened up to there only; of remote ones Spark reads all and keeps the head."""
    return heads_of(spark, list_files(spark, patterns), host, count, max_line)


def _head_bytes(path: str, count: int, max_line: int) -> list[bytes]:
    """As ``_head``, as bytes as they are in a plain file; no more than that is read."""
    most, data, size = count * (4 * max_line + 2), b"", 1 << 16
    with open(path, "rb") as f:
        while len(data) < most and (more := f.read(min(size, most - len(data)))):
            data, size = data + more, 2 * size
            lines = _cut(data.removeprefix(_BOM))
            if len(lines) > count or any(len(x) > 4 * max_line for x in lines):
                break
        else:
            lines = _cut(data.removeprefix(_BOM))
    if not lines[-1]:
        del lines[-1]
    own = []
    for line in lines[:count]:
        text = line if len(line) <= max_line else line.decode("utf-8", "replace")
        own.append(line if len(text) <= max_line else text[: max_line + 1].encode())
        if len(text) > max_line:
            break
    return own


def heads_of(spark: SparkSession, files: DataFrame, host: str = "localhost", count: int = 512, max_line: int = 1024) -> DataFrame:
    """As ``read_heads``, of files as from ``list_files``."""
    files = files.localCheckpoint()
    packed = re.compile(_PACKED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    try:
                        lines = [x.encode() for x in _head(path, count, max_line)] if packed.search(path) else _head_bytes(path, count, max_line)
                    except (OSError, EOFError, zlib.error):
                        continue
                    yield from _rows(path, 0, lines)

        return _gathered(each())

    local = files.where("path LIKE '/%'").select("path")
    own = _as_lines(_spread(local, local.count()).mapInArrow(read, _KINDS), host)
    remote = [r.path for r in files.where("path NOT LIKE '/%'").select("path").collect()]
    return own.unionByName(lines_of(spark, remote, host).where("split = 0")) if remote else own


def quarantined(outcomes: DataFrame, now: datetime.datetime, before: DataFrame | None = None, most: int = 512, keep_ms: int = 3_600_000) -> DataFrame:
    """path, error, since: files that couldn't be read now, or were put here within ``keep_ms``; the ``most`` latest. A file that fails again is as of now."""
    rows = outcomes.where("error IS NOT NULL").select("path", "error", F.lit(now).alias("since"))
    if before is not None:
        rows = rows.unionByName(before.where(F.col("since") + F.make_dt_interval(secs=F.lit(keep_ms / 1000)) > F.lit(now)).select("path", "error", "since"))
    rows = rows.groupBy("path").agg(F.max_by("error", "since").alias("error"), F.max("since").alias("since"))
    return rows.orderBy(F.desc("since"), "path").limit(most)


def write_texts(rows: DataFrame, root: str, place: Callable[[int], str]) -> None:
    """One local text file below ``root`` for each value of the first column, a whole number, at ``place`` of it: the texts of the second column, a line each. Rows of a value stand together, in order, in one partition.

    A file is there once it is whole, so that a task may run again.
    """
    key, text = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f, count = None, None, 0

        def close() -> None:
            f.close()
            os.replace(f.name, os.path.join(root, place(at)))

        for batch in batches:
            keys, texts = batch.column(key), batch.column(text)
            runs = pc.run_end_encode(keys, run_end_type=pa.int32())
            begin = 0
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if value != at:
                    if f:
                        close()
                    at, count = value, count + 1
                    whole = os.path.join(root, place(value))
                    os.makedirs(os.path.dirname(whole), exist_ok=True)
                    f = open(os.path.join(os.path.dirname(whole), f".{uuid.uuid4().hex}"), "wb")
                f.write(b"".join(x + b"\n" for x in texts.slice(begin, end - begin).cast(pa.binary()).to_pylist()))
                begin = end
        if f:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count])], ["files"])

    rows.mapInArrow(write, "files bigint").agg(F.sum("files")).collect()

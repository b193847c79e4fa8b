"""A streaming source that follows log files as they grow, rotate and are truncated.

    spark.dataSource.register(TailSource)
    spark.readStream.format("gclog_tail").option("globs", "/var/log/*/gc.log").load()

An offset holds an entry for each file that is followed: its inode, the byte up to which it has been read, the generation, which grows with each rotation, and the byte at which reading of
the generation began. Files that are idle and read up leave it for a bounded record of positions that ages, from which they go on if they grow again. A file is read up to its last line end, so that a line that is still being written waits.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .globs import Glob, once, walk

SCHEMA = "path string, host string, split bigint, pos bigint, line string"
#: A generation begins at this multiple of ``split``, so that lines of a rotated file sort after those before.
GENERATION = 1 << 48


class FilePart(InputPartition):
    """The lines that begin in [start, end) of a file whose bytes [first, stop) are to be read."""

    def __init__(self, path: str, inode: int, first: int, start: int, end: int, stop: int, generation: int) -> None:
        super().__init__(path)
        self.path, self.inode, self.first, self.start, self.end, self.stop, self.generation = path, inode, first, start, end, stop, generation


def last_line_end(path: str, start: int, end: int, size: int, block: int = 1 << 16) -> int:
    """The position after the last line end in [start, end), looked for from the end backwards; without one, after the first line end from ``end`` to ``size``; else ``start``."""
    with open(path, "rb") as f:
        high = end
        while high > start:
            low = max(start, high - block)
            f.seek(low)
            k = f.read(high - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            high = low
        f.seek(end)
        at = end
        while at < size and (data := f.read(min(block, size - at))):
            if (k := data.find(b"\n")) >= 0:
                return at + k + 1
            at += len(data)
    return start


def lines_within(path: str, start: int, size: int, most: float, block: int = 1 << 16) -> tuple[int, float]:
    """(where to stop so that about ``most`` lines from ``start`` are read, bytes to a line there), from one block: exact if the block has that many line ends, else by their mean length."""
    with open(path, "rb") as f:
        f.seek(start)
        data = f.read(min(block, size - start))
    ends = data.count(b"\n")
    if not ends:
        return start + len(data), float(max(len(data), 1))
    mean = (data.rindex(b"\n") + 1) / ends
    if ends < most:
        return start + int(mean * most), mean
    at = 0
    for _ in range(int(most)):
        at = data.index(b"\n", at) + 1
    return start + at, at / int(most)


def find_inode(path: str, inode: int) -> str | None:
    """Where the file with this inode is now: at ``path``, or under another name beside it (rotated)."""
    try:
        if os.stat(path).st_ino == inode:
            return path
    except OSError:
        pass
    try:
        return next((x.path for x in os.scandir(os.path.dirname(path)) if x.inode() == inode), None)
    except OSError:
        return None


class Bucket:
    """Tokens that come at a rate, up to what comes in a second (one at least)."""

    def __init__(self, rate: float) -> None:
        self.rate, self.most = rate, max(1.0, rate)

    def filled(self, tokens: float | None, seconds: float) -> float:
        return self.most if tokens is None else min(self.most, tokens + self.rate * max(seconds, 0.0))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict, clock: Callable[[], float] = time.time) -> None:
        option = lambda name, default: options.get(name.lower(), options.get(name, default))
        from ..config import split_patterns

        self.globs, self.regexes = [Glob(os.path.abspath(g)) for g in split_patterns(option("globs", ""))], [p for p in option("regexes", "").split(",") if p]
        self.host, self.clock = option("host", "localhost"), clock
        self.latest, self.new_at_end = option("startingOffsets", "latest") == "latest", option("newFileOffsets", "earliest") == "latest"
        self.most_bytes = int(option("maxBytesPerTrigger", 1 << 30))
        lines = float(option("linesPerSecond", 0))
        self.lines = Bucket(lines) if lines > 0 else None
        scans = float(option("scanFilesPerSecond", 0))
        self.scans, self.scan_tokens, self.scanned_at = Bucket(scans) if scans > 0 else None, None, self.clock()
        self.idle, self.memory = int(option("idleTimeout", 3_600_000)) / 1000, int(option("positionMemory", 86_400_000)) / 1000
        self.most_positions, self.most_quarantined, self.quarantine_seconds = int(option("maxPositions", 10_000)), int(option("maxQuarantined", 512)), int(option("quarantineTimeout", 3_600_000)) / 1000
        self.part_bytes, self.batch_lines, self.buffer_bytes = int(option("partitionBytes", 64 << 20)), int(option("batchLines", 16_384)), int(option("bufferBytes", 1 << 20))
        self.watch = int(option("watchInterval", 0)) / 1000
        self.quarantine: dict[str, float] = {}
        self.state: dict = {}
        self.fresh = True  # whether ``state`` knows no offset of before
        self.renumbered: dict[str, tuple[int, int]] = {}  # generations that the first end after a restart didn't know, beside those that it has
        self.listed: list[str] = []
        self.found: list[str] = []
        self.listed_at = 0.0
        self.walking: Iterator | None = None
        self.whole = False  # whether all files have been listed once

    # What is there

    def visit(self, path: str) -> bool:
        """Take a token for a file that is looked at; False when none is left."""
        if self.scans is None:
            return True
        if self.scan_tokens < 1:
            return False
        self.scan_tokens -= 1
        return True

    def failed(self, path: str, error: OSError) -> None:
        self.quarantine[path] = self.clock()

    def matches(self) -> Iterator[str | None]:
        """Paths that match, and None where the scan rate asks to go on at the next trigger."""
        for entry in walk(self.globs, self.visit, self.failed):
            yield entry and entry.path
        for pattern in self.regexes:
            folder, name = os.path.split(os.path.abspath(pattern))
            for x in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                while not self.visit(x):
                    yield None
                if re.fullmatch(name, x) and os.path.isfile(os.path.join(folder, x)):
                    yield os.path.join(folder, x)

    def files(self) -> list[str]:
        """Regular files that match, each once, less those in quarantine. They are listed anew after ``watchInterval``; with a scan rate a listing goes on over as many triggers as it needs, and files found so far count with those of the listing before."""
        now = self.clock()
        if self.scans is not None:
            self.scan_tokens, self.scanned_at = self.scans.filled(self.scan_tokens, now - self.scanned_at), now
        if self.walking is None and (now - self.listed_at >= self.watch or not self.listed):
            self.walking, self.found, self.listed_at = self.matches(), [], now
        if self.walking is not None:
            for path in self.walking:
                if path is None:
                    break
                self.found.append(path)
            else:
                self.walking, self.whole = None, True
            known = self.found if self.walking is None else self.listed + self.found
            self.listed = sorted(once(known).values())
        kept = sorted(self.quarantine.items(), key=lambda x: (-x[1], x[0]))[: self.most_quarantined]
        self.quarantine = {p: t for p, t in kept if now - t <= self.quarantine_seconds}
        return [p for p in self.listed if p not in self.quarantine]

    # Where reading stands

    def empty(self) -> dict:
        return {"files": {}, "left": {}, "tokens": {}, "quarantine": {}, "time": self.clock(), "whole": False}

    @staticmethod
    def encoded(state: dict) -> dict:
        return {k: json.dumps(v, sort_keys=True) for k, v in state.items()}

    @staticmethod
    def decoded(offset: dict) -> dict:
        return {k: json.loads(v) for k, v in offset.items()}

    def initialOffset(self) -> dict:
        """The files that are there, each at its end or its beginning."""
        return self.encoded(self.start())

    def start(self) -> dict:
        state, now = self.empty(), self.clock()
        for p in self.files():
            try:
                s = os.stat(p)
            except OSError:
                continue
            if now - s.st_mtime <= self.idle:
                at = s.st_size if self.latest else 0
                state["files"][p] = [s.st_ino, at, 0, at]
        return state | {"whole": self.whole, "quarantine": self.quarantine}

    def advance(self, state: dict) -> dict:
        """Where each file may be read up to, from sizes and a block or two of what is new.

        Files found while the first listing goes on start as ``startingOffsets`` says, later ones at 0 (or at their end, by ``newFileOffsets``); rotated or truncated ones the same, in a new generation. A file known by its inode under another name goes on where
        it was. A file that is idle for longer than ``idleTimeout`` and read up, or gone, leaves its position in ``left``, for ``positionMemory`` and the latest ``maxPositions`` of them. With ``linesPerSecond`` each file has a bucket of tokens,
        one for a line; what isn't used is there at the next trigger.
        """
        now, listed = self.clock(), self.files()
        followed = state["files"]
        before = {p: e[:4] for p, e in state["left"].items()} | followed
        by_inode = {e[0]: e for e in before.values()}
        after, tokens = {}, {}
        for p in listed:
            try:
                s = os.stat(p)
                idle = now - s.st_mtime > self.idle
                if p in before:
                    inode, at, generation, begin = before[p]
                elif idle:
                    continue
                elif s.st_ino in by_inode:
                    inode, generation, begin = s.st_ino, 0, min(by_inode[s.st_ino][1], s.st_size)
                    at = begin
                else:
                    inode, generation, begin = s.st_ino, 0, s.st_size if (self.new_at_end if state["whole"] else self.latest) else 0
                    at = begin
                if inode != s.st_ino or s.st_size < at:
                    inode, generation, begin = s.st_ino, generation + 1, s.st_size if self.new_at_end else 0
                    at = begin
                stop = at
                if s.st_size > at:
                    high = min(s.st_size, at + self.most_bytes)
                    if self.lines is None:
                        stop = last_line_end(p, at, high, s.st_size)
                    else:
                        have = self.lines.filled(state["tokens"].get(p), now - state["time"])
                        if have >= 1:
                            limit, mean = lines_within(p, at, s.st_size, have)
                            stop = last_line_end(p, at, min(high, limit), s.st_size)
                            have -= max((stop - at) / mean, 0)
                        if have < self.lines.most:
                            tokens[p] = have
                if idle and stop == at and s.st_size - at < self.buffer_bytes and p not in tokens:
                    continue  # at most a line without an end is left
                after[p] = [inode, stop, generation, begin]
            except OSError as error:
                self.failed(p, error)
                if p in followed:
                    after[p] = followed[p]
        left = {p: state["left"].get(p, [*e, now]) for p, e in before.items() if p not in after}
        left = dict(sorted(((p, e) for p, e in left.items() if now - e[4] <= self.memory), key=lambda x: (-x[1][4], x[0]))[: self.most_positions])
        return {"files": after, "left": left, "tokens": tokens, "quarantine": self.quarantine, "time": now, "whole": state["whole"] or self.whole}

    def latestOffset(self) -> dict:
        self.state = self.advance(self.state or self.start())
        return self.encoded(self.state)

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        """Parts by bytes; whose lines are whose is for the tasks to see.

        The first end after a restart was made without knowing the offset of before; what that one tells of a file counts then, and is remembered.
        """
        before, after, out = self.decoded(start), self.decoded(end), []
        self.quarantine = after["quarantine"] | self.quarantine
        self.state = self.state or after
        known = {p: e[:4] for p, e in before["left"].items()} | before["files"]
        for p, (inode, stop, generation, begin) in after["files"].items():
            old, first = known.get(p), begin
            if old and p in self.renumbered and old[2] == self.renumbered[p][0]:
                old = [*old[:2], self.renumbered[p][1], old[3]]
            if old and old[0] == inode and old[1] <= stop and (old[2] == generation or self.fresh):
                first, generation, begin = old[1], max(old[2], generation), old[3]
            elif self.fresh and before["whole"] and not self.new_at_end:
                first, generation, begin = 0, old[2] + 1 if old else generation, 0
            if self.fresh and p in self.state["files"]:
                if generation != after["files"][p][2]:
                    self.renumbered[p] = after["files"][p][2], generation
                self.state["files"][p][2:] = [generation, begin]
            out += [FilePart(p, inode, first, at, min(at + self.part_bytes, stop), stop, generation) for at in range(first, stop, self.part_bytes)]
        if self.fresh:
            self.state["left"] = {p: e for p, e in before["left"].items() if p not in self.state["files"]} | self.state["left"]
            self.state["whole"] = before["whole"] or self.state["whole"]
            self.fresh = False
        return out

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        """The part's lines in batches; a file that was rotated meanwhile is read under its new name, one that is gone has no lines."""
        path = find_inode(part.path, part.inode)
        if path is None:
            return
        try:
            f = open(path, "rb")  # noqa: SIM115
        except OSError:
            return
        with f:
            at = part.start
            if at > part.first:  # a line that began in the part before belongs to it
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            pos, texts, size = [], [], 0
            while at < part.end and (line := f.readline(part.stop - at)).endswith(b"\n"):
                pos.append(at)
                texts.append(line[:-1].removesuffix(b"\r").decode("utf-8", "replace"))
                at, size = at + len(line), size + len(line)
                if len(pos) >= self.batch_lines or size >= self.buffer_bytes:
                    yield self.rows(part, pos, texts)
                    pos, texts, size = [], [], 0
            if pos:
                yield self.rows(part, pos, texts)

    def rows(self, part: FilePart, pos: list[int], texts: list[str]) -> pa.RecordBatch:
        n, split = len(pos), part.generation * GENERATION
        columns = [pa.array([part.path] * n, pa.string()), pa.array([self.host] * n, pa.string()), pa.array([split] * n, pa.int64()), pa.array(pos, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "host", "split", "pos", "line"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: globs, regexes (comma-separated), host, startingOffsets (latest or earliest: files that are there at the start), newFileOffsets (earliest or latest: files that come later, or rotate), maxBytesPerTrigger (per file), linesPerSecond (per file; 0: no limit),
    idleTimeout, positionMemory, quarantineTimeout and watchInterval (ms), maxPositions, maxQuarantined, partitionBytes, batchLines and bufferBytes (of what a task holds), scanFilesPerSecond (0: no limit)."""

    @classmethod
    def name(cls) -> str:
        return "gclog_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))

"""Keyed state of the files of a stream of lines: dialect, lines that wait for the rest of their event, and when a file is idle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions import grammar as G
from ..operators.dialect import tell
from ..registry import DIALECTS

#: kind is "line" (a line that can be parsed, with its file's dialect), "file" (what a batch had of a file: n lines) or "closed" (a file has become idle).
SCHEMA = "kind string, path string, host string, split bigint, pos bigint, line string, unified boolean, collector string, family string, region_kib bigint, n bigint, at_ms bigint"

_GC_ID = re.compile(G.GC_ID, re.ASCII)
_ENDS = {
    "unified": re.compile(f"{G.GC_ID} *(?:{G.UNIFIED_PAUSE}|{G.UNIFIED_CONCURRENT})", re.ASCII), "zgc": re.compile(f"{G.GC_ID} *{G.ZGC_END}", re.ASCII), "block": re.compile(G.G1_HEAD, re.ASCII),
}


def waiting(lines: list[str], unified: bool, family: str) -> list[bool]:
    """Which lines, in order, belong to an event whose end hasn't come: those after the last line that ends an event of their gc_id, or from the last head of a legacy G1 log on."""
    out = [False] * len(lines)
    if family == "g1" and not unified:
        last = next((k for k in range(len(lines) - 1, -1, -1) if _ENDS["block"].search(lines[k])), 0)
        return [k >= last for k in range(len(lines))]
    if unified or family == "zgc":
        ends, ended = _ENDS["zgc" if family == "zgc" else "unified"], set()
        for k in range(len(lines) - 1, -1, -1):
            if m := _GC_ID.search(lines[k]):
                if ends.search(lines[k]):
                    ended.add(m[1])
                out[k] = m[1] not in ended
    return out


class FileState(StatefulProcessor):
    """State of one (path, host): its dialect, told once from the first lines of a batch that has a signal; the lines of unfinished events; a timer that runs out ``idle_ms`` after the last line.

    When the timer runs out, held lines go and a "closed" row says that all series of the file are to go. The dialect stays for ``memory`` times as long (by its time to live), for the case that the file grows again. Times are those of the
    batch, which its log keeps, so a batch that is run again gives the same rows. What one key holds at a time is what a trigger admits of a file.
    """

    def __init__(self, idle_ms: int, memory: int, header_lines: int, max_header_line: int, added: tuple[tuple[str, str], ...] = ()) -> None:
        self.idle_ms, self.memory, self.header_lines, self.max_header_line, self.added = idle_ms, memory, header_lines, max_header_line, added

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dialect = handle.getValueState("dialect", "unified boolean, collector string, family string, region_kib bigint", ttlDurationMs=self.idle_ms * self.memory)
        self.held = handle.getListState("held", "split bigint, pos bigint, line string")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.timer.exists():
            before = self.timer.get()[0]
            self.handle.deleteTimer(before)
            if before <= now:  # it was idle for too long, though no batch came to see it
                self.held.clear()
                yield self.rows(key, now, [("closed", None, None, None)], None, None)
        self.handle.registerTimer(now + self.idle_ms)
        self.timer.update((now + self.idle_ms,))
        new = sorted((r for pdf in rows for r in zip(pdf["split"].tolist(), pdf["pos"].tolist(), pdf["line"].tolist())), key=lambda r: r[:2])
        dialect = tuple(self.dialect.get()) if self.dialect.exists() else tell([r[2] for r in new[: self.header_lines]], self.max_header_line, self.added)
        yield self.rows(key, now, [("file", None, None, None)], dialect, len(new))
        if dialect is None:
            return
        self.dialect.update(dialect)
        work = [*(tuple(r) for r in self.held.get()), *new] if self.held.exists() else new
        waits = waiting([r[2] for r in work], bool(dialect[0]), dialect[2])
        held = [r for r, w in zip(work, waits) if w]
        if held:
            self.held.put(held)
        else:
            self.held.clear()
        ready = [("line", *r) for r, w in zip(work, waits) if not w]
        for k in range(0, len(ready), 10_000):
            yield self.rows(key, now, ready[k : k + 10_000], dialect, None)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.timer.clear()
        yield self.rows(key, timerValues.getCurrentProcessingTimeInMs(), [("closed", None, None, None)], None, None)

    def rows(self, key, now: int, rows: list[tuple], dialect: tuple | None, n: int | None) -> pd.DataFrame:
        kind, split, pos, line = (list(c) for c in zip(*rows))
        count = len(rows)
        unified, collector, family, region = dialect or (None,) * 4
        integer = lambda values: pd.array(values, "Int64")
        return pd.DataFrame({
            "kind": kind, "path": [key[0]] * count, "host": [key[1]] * count, "split": integer(split), "pos": integer(pos), "line": line, "unified": pd.array([unified] * count, "boolean"), "collector": [collector] * count, "family": [family] * count,
            "region_kib": integer([None if region is None else int(region)] * count), "n": integer([n] * count), "at_ms": integer([now] * count),
        })

    def close(self) -> None:
        pass


def follow(lines: DataFrame, idle_ms: int = 3_600_000, memory: int = 24, header_lines: int = 512, max_header_line: int = 1024) -> DataFrame:
    """A stream of lines (path, host, split, pos, line) as a stream of ``SCHEMA``, by ``FileState``; files are dealt to all tasks. Needs the RocksDB state store."""
    state = FileState(idle_ms, memory, header_lines, max_header_line, tuple((d.name, d.signal) for d in DIALECTS.values()))
    return lines.groupBy("path", "host").transformWithStateInPandas(state, SCHEMA, outputMode="Update", timeMode="ProcessingTime")

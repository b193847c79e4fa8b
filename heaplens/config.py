"""Settings of a log job, checked on creation."""

from __future__ import annotations

import re
import socket
from dataclasses import dataclass, field


def split_patterns(text: str) -> list[str]:
    """Comma-separated patterns; commas within braces belong to a pattern."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "{") - (ch == "}")
        if ch == "," and depth <= 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [p for p in [*out, part.strip()] if p]


def host_name() -> str:
    """This machine's name; "localhost" where it can't be told."""
    try:
        return socket.gethostname() or "localhost"
    except OSError:
        return "localhost"


@dataclass(frozen=True)
class LogConfig:
    """globs and regexes may be lists or comma-separated text. Times are in milliseconds.

    max_bytes_per_trigger is what a batch takes of one file, which one task holds; new_file_offsets says where files begin that come, or rotate, after the start: "earliest" (nothing is lost) or "latest".
    host labels the series (default: the machine's name); listen is where the page is served, as "host:port" or "port", and takes the place of ``port``.
    """

    globs: list[str] | str = field(default_factory=list)
    regexes: list[str] | str = field(default_factory=list)
    host: str = ""
    listen: str = ""
    port: int = 5898
    prefix: str = "gc_"
    idle_timeout: int = 3_600_000
    batch_size: int = 1024
    buffer_size: int = 8192
    lines_per_second: int = 2**31 - 1
    watch_interval: int = 30_000
    read_interval: int = 1_000
    scan_files_per_second: int = 0
    max_bytes_per_trigger: int = 64 << 20
    new_file_offsets: str = "earliest"
    header_lines: int = 512
    max_header_line: int = 1024
    strict_zgc: bool = False

    def __post_init__(self) -> None:
        for name in ("globs", "regexes"):
            if isinstance(value := getattr(self, name), str):
                object.__setattr__(self, name, split_patterns(value))
        if not self.host:
            object.__setattr__(self, "host", host_name())
        if self.listen:
            object.__setattr__(self, "port", int(self.listen.rpartition(":")[2]))
        if not (self.globs or self.regexes):
            raise ValueError("at least one pattern is needed")
        if not 1000 <= self.port <= 65535:
            raise ValueError("port must be from 1000 to 65535")
        for name in ("idle_timeout", "batch_size", "buffer_size", "lines_per_second", "watch_interval", "read_interval", "header_lines", "max_header_line", "max_bytes_per_trigger"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.new_file_offsets not in ("earliest", "latest"):
            raise ValueError("new_file_offsets must be earliest or latest")
        if self.scan_files_per_second < 0:
            raise ValueError("scan_files_per_second must not be negative")
        for pattern in self.regexes:
            re.compile(pattern)

    @property
    def listen_host(self) -> str:
        """The address to serve at; empty for all."""
        return self.listen.rpartition(":")[0]

    @classmethod
    def from_mapping(cls, values: dict) -> LogConfig:
        """Unknown keys are ignored, as are nulls."""
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

"""What a user adds at run time: dialects of logs with their category rules, and metric families. Plans made afterwards know them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .plans.catalog import ADDED, Family, families

#: Names that the package's own dialects have.
OWN = ("g1", "zgc", "classic", "cms", "serial", "parallel")


@dataclass(frozen=True)
class Dialect:
    """A log dialect. Files without a signal of the package's own dialects are told by ``signal``, in the order in which dialects were added.

    parse: from lines of such files (path, host, split, pos, line, unified, collector, family, region_kib) to a row for each event: these columns but the line, label, duration_s, and any others of gc_events. taken: what lines its rules take, for the table of rejects.
    categories: (pattern, category) by label, the first that fits decides, else ``otherwise``. concurrent: labels of events that are no pauses. Patterns are read by Java and Python alike.
    """

    name: str
    signal: str
    parse: Callable[[DataFrame], DataFrame]
    taken: str
    categories: tuple[tuple[str, str], ...] = ()
    otherwise: str = "Unknown"
    concurrent: str | None = None


#: By name, in the order in which they were added.
DIALECTS: dict[str, Dialect] = {}


def add_dialect(dialect: Dialect) -> None:
    if dialect.name in OWN or dialect.name in DIALECTS or not re.fullmatch(r"\w+", dialect.name):
        raise ValueError(f"{dialect.name!r} is taken or no name")
    for pattern in (dialect.signal, dialect.taken, *(p for p, _ in dialect.categories), *filter(None, [dialect.concurrent])):
        re.compile(pattern)
    DIALECTS[dialect.name] = dialect


def add_family(family: Family) -> None:
    """Add a metric family; ``others`` has its expressions over gc_events by dialect."""
    if family.name in {f.name for f in families()}:
        raise ValueError(f"there is a family {family.name!r}")
    if family.kind not in ("gauge", "summary"):
        raise ValueError("a family is a gauge or a summary")
    ADDED.append(family)


def remove(name: str) -> None:
    """Take back the dialect or family of that name that was added; nothing if there is none."""
    DIALECTS.pop(name, None)
    ADDED[:] = [f for f in ADDED if f.name != name]

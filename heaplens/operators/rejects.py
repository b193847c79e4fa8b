"""What became of each line: taken by a rule of its file's dialect, blank, or rejected, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..registry import DIALECTS
from .dialect import bounded
from .events import DIALECT, parse_known


def taken(line: Column, unified: Column, family: Column) -> Column:
    """Whether a rule of the dialect takes a line: it makes an event or tells of one."""
    message = lambda *patterns: line.rlike(f"{G.GC_ID} *(?:{'|'.join(patterns)})")
    reference = line.contains("Reference, ") & line.rlike(G.REFERENCE)
    out = (
        F.when(family == "zgc", message(G.ZGC_END, G.ZGC_PHASE, G.ZGC_LOAD, G.ZGC_MMU, G.ZGC_METASPACE, G.ZGC_ROW))
        .when(family.isin("g1", "classic") & unified, message(G.UNIFIED_PAUSE, G.UNIFIED_CONCURRENT, G.REGIONS, G.UNIFIED_METASPACE))
        .when(family == "classic", line.contains(" secs]") & (line.rlike(G.LEGACY_TAIL) | line.rlike(G.CMS_PAUSE) | line.rlike(G.CMS_CONCURRENT)))
        .when(family == "g1", line.rlike(G.G1_HEAD) | line.rlike(G.G1_POOLS) | line.rlike(r"\[Metaspace: " + G.POOL) | line.rlike(G.G1_SECS) | line.rlike(r"^ *\[Times|^, \d") | reference)
    )
    for d in DIALECTS.values():
        out = out.when(family == d.name, line.rlike(d.taken))
    return F.coalesce(out, F.lit(False))


def outcomes(lines: DataFrame, diaries: DataFrame) -> DataFrame:
    """``lines`` with their file's dialect (null without one), outcome and reason.

    outcome is "taken", "blank" or "rejected", so that the three add up to all lines. A rejected line has a reason: "unsupported file" (its file has no diary) or "no rule" (none of its dialect takes it: it is malformed, of a kind that no metric needs, or
    cut short). One pass over the lines; the diary goes to the tasks as for ``parse_events``.
    """
    known = lines.join(bounded(diaries.select("path", "host", *DIALECT)), ["path", "host"], "left")
    outcome = F.when(F.trim("line") == "", "blank").when(taken(F.col("line"), F.col("unified"), F.col("family")), "taken").otherwise("rejected")
    reason = F.when(F.col("outcome") == "rejected", F.when(F.col("family").isNull(), "unsupported file").otherwise("no rule"))
    return known.withColumn("outcome", outcome).withColumn("reason", reason)


def parse_with_rejects(lines: DataFrame, diaries: DataFrame, only: list[tuple[bool, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): the events of the lines that rules take, as ``parse_events`` has them, and the lines that none takes (path, host, split, pos, line, unified, collector, family, reason)."""
    told = outcomes(lines, diaries)
    events = parse_known(told.where("outcome = 'taken'").drop("outcome", "reason"), only)
    return events, told.where("outcome = 'rejected'").select("path", "host", "split", "pos", "line", "unified", "collector", "family", "reason")

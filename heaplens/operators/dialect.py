"""The diary: which collector and log dialect each file has, from the head of the file."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..registry import DIALECTS


#: Files up to which what is known of them goes to all tasks, some 200 bytes for each file.
BROADCAST_FILES = 1_000_000


def bounded(files: DataFrame) -> DataFrame:
    """A table with one row for each file, broadcast if it has at most ``BROADCAST_FILES`` rows, so that lines needn't be shuffled by file."""
    return F.broadcast(files) if files.count() <= BROADCAST_FILES else files


def head_lines(lines: DataFrame, count: int = 512) -> DataFrame:
    """The first ``count`` lines of each file, less the blank ones (which count).

    Lines of files of at most ``count`` lines needn't be put in order. Those of files of up to eight times as many are dealt by file, a bounded number of lines each, and put in order there;
    of larger files each task keeps its own first ``count`` lines before they are dealt.
    """
    lines = lines.where("split = 0")
    sizes = lines.groupBy("path", "host").agg(F.count("*").alias("size")).localCheckpoint()
    rows = lines.join(bounded(sizes), ["path", "host"])
    text = F.trim("line") != ""
    first = lambda df: df.withColumn("n", F.row_number().over(W.partitionBy("path", "host").orderBy("split", "pos"))).where(F.col("n") <= count).where(text).select(*lines.columns)
    out = rows.where(F.col("size") <= count).where(text).select(*lines.columns)
    if not sizes.where(f"size > {count} AND size <= {8 * count}").isEmpty():
        out = out.unionByName(first(rows.where(f"size > {count} AND size <= {8 * count}").repartition("path", "host")))
    if not sizes.where(F.col("size") > 8 * count).isEmpty():
        out = out.unionByName(first(rows.where(F.col("size") > 8 * count)))
    return out


def _told(signals: DataFrame, max_line: int) -> DataFrame:
    """The diary from what stands in the heads of files: a truth value for each signal, region_mb and longest."""
    collector = (
        F.when(F.col("g1"), "g1").when(F.col("zgc"), "zgc").when(F.col("cms") | F.col("parnew"), "cms").when(F.col("defnew") | F.col("serial_full"), "serial").when(F.col("parallel"), "parallel")
    )
    for d in DIALECTS.values():
        collector = collector.when(F.col(f"added_{d.name}"), d.name)
    signals = signals.where(F.col("longest") <= max_line).withColumn("collector", collector).where("collector IS NOT NULL")
    family = F.when(F.col("collector").isin("g1", "zgc", *DIALECTS), F.col("collector")).otherwise("classic")
    return signals.select("path", "host", "unified", "collector", family.alias("family"), (F.col("region_mb") * 1024).alias("region_kib"))


def _marked(lines: DataFrame) -> DataFrame:
    """With what ``_tests`` asks first of a line, a column of its own, so that it is told once for all signals."""
    return lines.withColumn("marked", functools.reduce(lambda x, y: x | y, [F.col("line").contains(x) for x in G.SIGNAL_MARKS]))


def _tests() -> dict[str, Column]:
    """Whether a line gives each of the signals. Plain tests come first, so that most lines meet no pattern."""
    line = F.col("line")
    own = {k: F.when(F.col("marked"), line.rlike(p)).otherwise(False) for k, p in G.SIGNALS.items()}
    return {"unified": F.when(line.startswith("["), line.rlike(G.UNIFIED)).otherwise(False), **own, **{f"added_{d.name}": line.rlike(d.signal) for d in DIALECTS.values()}}


def _region() -> Column:
    sized = F.col("line").contains("egion")
    return F.when(sized, G.number(F.coalesce(F.nullif(F.regexp_extract("line", G.REGION_SIZE, 1), F.lit("")), F.nullif(F.regexp_extract("line", G.REGION_SIZE, 2), F.lit("")))))


def diary(lines: DataFrame, count: int = 512, max_line: int = 1024) -> DataFrame:
    """One row for each supported file: path, host, unified, collector, family, region_kib.

    The first rule that fits decides: G1, ZGC, CMS or ParNew, DefNew, a serial full collection, Parallel. Files without a signal, and
    files with a line of over ``max_line`` characters in the head, are unsupported and have no row.

    Lines aren't sorted: one grouping by file, combined before its shuffle, gives the first place of each signal and the number of lines. Places are whole numbers that differ within a split, so a
    place within ``count`` of the file's first is in its head, and so is any place of a file of at most ``count`` lines. Only lines of files where that leaves something open are put in order (``head_lines``).
    That grouping runs when this is called and is kept on the executors, one row for each file.
    """
    tests = _tests()
    text = F.col("text")
    rows = _marked(lines.where("split = 0").withColumn("text", F.trim("line") != "")).select("path", "host", "pos", "text", (text & (F.length("line") > max_line)).alias("long"), _region().alias("mb"), *[(text & x).alias(k) for k, x in tests.items()])
    at = lambda test: F.min(F.when(test, F.col("pos")))
    firsts = rows.groupBy("path", "host").agg(
        F.count("*").alias("n"), F.min("pos").alias("begin"), *[at(F.col(k)).alias(f"at_{k}") for k in ("text", "long", *tests)],
        F.max("mb").alias("mb"), F.max(F.when(F.col("mb").isNotNull(), F.col("pos"))).alias("at_mb"),
    ).localCheckpoint()
    near = lambda k: F.col(f"at_{k}").isNull() | (F.col("n") <= count) | (F.col(f"at_{k}") - F.col("begin") < count)
    # a collector's signal further down changes nothing after a rule that fits before it
    plain, told = functools.reduce(lambda x, y: x & y, [near(k) for k in ("text", "long", "mb", "unified")]), F.lit(False)
    for k in (k for k in tests if k != "unified"):
        plain, told = plain & (told | near(k)), told | (F.col(f"at_{k}").isNotNull() & near(k))
    firsts = firsts.withColumn("plain", plain)
    known = firsts.where("plain AND at_text IS NOT NULL").select("path", "host", *[F.col(f"at_{k}").isNotNull().alias(k) for k in tests], F.col("mb").alias("region_mb"), F.when(F.col("at_long").isNotNull(), max_line + 1).otherwise(0).alias("longest"))
    out = _told(known, max_line)
    # signals that begin further down
    open_ = firsts.where("NOT plain").select("path", "host")
    if not open_.isEmpty():
        signals = _marked(head_lines(lines.join(bounded(open_), ["path", "host"], "left_semi"), count)).groupBy("path", "host").agg(*[F.max(x).alias(k) for k, x in tests.items()], F.max(_region()).alias("region_mb"), F.max(F.length("line")).alias("longest"))
        out = out.unionByName(_told(signals, max_line).localCheckpoint())
    return out


_UNIFIED, _REGION = re.compile(G.UNIFIED, re.ASCII), re.compile(G.REGION_SIZE, re.ASCII)
_SIGNALS = {name: re.compile(pattern, re.ASCII) for name, pattern in G.SIGNALS.items()}


def tell(head: Sequence[str], max_line: int = 1024, added: Sequence[tuple[str, str]] = ()) -> tuple[bool, str, str, int | None] | None:
    """The diary of one file from its first lines: (unified, collector, family, region_kib), or None if it is unsupported; ``added`` has name and signal of dialects that a user has added; the rules of ``diary``, for code that has one file's lines at hand."""
    head = [x for x in head if x.strip(" ")]
    if not head or max(map(len, head)) > max_line:
        return None
    has = {name: any(map(signal.search, head)) for name, signal in _SIGNALS.items()}
    rules = (("g1", has["g1"]), ("zgc", has["zgc"]), ("cms", has["cms"] or has["parnew"]), ("serial", has["defnew"] or has["serial_full"]), ("parallel", has["parallel"]), *((name, any(re.search(signal, x, re.ASCII) for x in head)) for name, signal in added))
    collector = next((name for name, fits in rules if fits), None)
    if collector is None:
        return None
    sizes = [int(m[1] or m[2]) for m in map(_REGION.search, head) if m]
    family = collector if collector in ("g1", "zgc", *(name for name, _ in added)) else "classic"
    return any(map(_UNIFIED.search, head)), collector, family, max(sizes) * 1024 if sizes else None

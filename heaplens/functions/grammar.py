"""Grammar of GC log lines, as patterns for Spark's regular expressions and builders of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "\x01"
SIZE = r"(\d+(?:\.\d+)?)([BKMG])"

GC_ID = r"GC\((\d+)\) "
# Unified logging: messages, that is, what follows "GC(n) " and blanks
UNIFIED_PAUSE = r"(Pause .+?) (\d+)([KMG])->(\d+)([KMG])\((\d+)([KMG])\) (\d+\.\d+)ms"
UNIFIED_CONCURRENT = r"(Concurrent .+?) (\d+\.\d+)ms"
REGIONS = r"(Eden|Survivor|Old|Humongous|Archive) regions: (\d+)->(\d+)(?:\((\d+)\))?"
UNIFIED_METASPACE = r"Metaspace: (\d+)K(?:\((\d+)K\))?->(\d+)K\((\d+)K\)"
UPTIME = r"\[(\d+\.\d+)s\]"
STAMP = r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+[+-]\d{4})"
REFERENCE = r"\[?(Soft|Weak|Final|Phantom|JNI Weak) ?Reference, (?:(\d+) refs, )?(?:(\d+) refs, )?(\d+\.\d+) secs\]?"

# Messages of the Z collector
ZGC_END = r"Garbage Collection \((.+?)\) (\d+)([KMG])\(\d+%\)->(\d+)([KMG])\(\d+%\)"
ZGC_PHASE = r"(Pause Mark Start|Concurrent Mark|Concurrent Mark Free|Pause Mark End|Concurrent Process Non-Strong References|Concurrent Reset Relocation Set|Concurrent Select Relocation Set|Pause Relocate Start|Concurrent Relocate) (\d+\.\d+)ms"
ZGC_LOAD = r"Load: (\d+\.\d+)/(\d+\.\d+)/(\d+\.\d+)"
ZGC_MMU = r"MMU: 2ms/(\d+\.\d+)%, 5ms/(\d+\.\d+)%, 10ms/(\d+\.\d+)%, 20ms/(\d+\.\d+)%, 50ms/(\d+\.\d+)%, 100ms/(\d+\.\d+)%"
ZGC_METASPACE = r"Metaspace: (\d+)([KMG]) used, (?:\d+[KMG] capacity, )?(\d+)([KMG]) committed, (\d+)([KMG]) reserved"
_CELL = r"\s+(?:-|(\d+)([KMG])(?: ?\(\d+%\))?)"
ZGC_ROWS = ("Used", "Free", "Live", "Allocated", "Garbage", "Reclaimed", "Memory")
ZGC_ROW = "(" + "|".join(ZGC_ROWS) + "):" + _CELL * 4

# Legacy logging
POOL = r"(\d+)K->(\d+)K\((\d+)K\)"
LEGACY_TAIL = r"(\d+)K->(\d+)K\((\d+)K\)(?:, \[(?:Metaspace|Perm ?):? ?(\d+)K->(\d+)K\((\d+)K\)\])?, (\d+\.\d+) secs\](?: \[Times:|\s*$)"
LEGACY_YOUNG = r"\[(?:PSYoungGen|ParNew(?: \(promotion failed\))?|DefNew(?: \(promotion failed\))?): " + POOL
LEGACY_OLD = r"\[(?:ParOldGen|PSOldGen|Tenured|CMS(?: \(concurrent mode (?:failure|interrupted)\))?): " + POOL
CMS_PAUSE = r"\[1 CMS-(initial-mark|remark): (\d+)K\((\d+)K\)\] (\d+)K\((\d+)K\), (\d+\.\d+) secs\]"
CMS_CONCURRENT = r"\[CMS-concurrent-(mark|preclean|abortable-preclean|sweep|reset): (\d+\.\d+)/(\d+\.\d+) secs\]"
CMS_CLASS_UNLOADING = r"\[class unloading, (\d+\.\d+) secs\]"
CMS_SYMBOL = r"\[scrub symbol table, (\d+\.\d+) secs\]"
CMS_STRING = r"\[scrub string table, (\d+\.\d+) secs\]"
CMS_SYMBOL_STRING = r"\[scrub symbol & string tables, (\d+\.\d+) secs\]"
LEGACY_UPTIME = r"^(?:\d{4}-\d\d-\d\dT\S+: )?(\d+\.\d+): "
G1_HEAD = r"^(?:\d{4}-\d\d-\d\dT[\d:.]+[+-]\d{4}: )?(?:\d+\.\d+: )?\[(GC pause \(.*\) \((?:young|mixed)\)(?: ?\(initial-mark\))?(?: ?\(to-space exhausted\))?|GC remark|GC cleanup|GC concurrent-[a-z-]+-end|Full GC \(.*?\))"
G1_SECS = r"^.*, (\d+\.\d+) secs\]"
G1_POOLS = r"\[Eden: {0}\({0}\)->{0}\({0}\) Survivors: {0}->{0} Heap: {0}\({0}\)->{0}\({0}\)\]".format(SIZE)
G1_HEAD_HEAP = r"(\d+)([BKMG])->(\d+)([BKMG])\((\d+)([BKMG])\), \d+\.\d+ secs\]"

# Signals in the head of a file
SIGNALS = {
    "g1": r"Using G1|-XX:\+UseG1GC",
    "zgc": r"Using The Z Garbage Collector|-XX:\+UseZGC",
    "cms": r"Using Concurrent Mark Sweep|-XX:\+UseConcMarkSweepGC",
    "parnew": r"-XX:\+UseParNewGC|\[ParNew",
    "defnew": r"\[DefNew",
    "serial_full": r"Using Serial|-XX:\+UseSerialGC|\[Tenured",
    "parallel": r"Using Parallel|-XX:\+UseParallel(?:Old)?GC|\[PSYoungGen|\[ParOldGen|\[PSOldGen",
}
#: One of these is in every line with a signal.
SIGNAL_MARKS = ("Using ", "-XX:+Use", "[ParNew", "[DefNew", "[Tenured", "[PSYoungGen", "[ParOldGen", "[PSOldGen")
REGION_SIZE = r"Heap region size: (\d+)M|-XX:G1HeapRegionSize=(\d+)m"
UNIFIED = r"^(?:\[[^\]]*\])+ *(?:Using |Heap region|GC\(|Initializing|Version|CPUs|Memory)|^\[[\d.]+s\]|^\[\d{4}-"


def cut(line: Column, pattern: str, count: int) -> Column:
    """Groups 1..count of the first match as array<string>, and an empty one (see ``fit``); another number of pieces without a match. One pass of the pattern over the line; a group that took no part is empty."""
    return F.split(F.regexp_replace(line, f"^.*?(?:{pattern}).*$", _SEP.join(f"${k}" for k in range(1, count + 1)) + _SEP), _SEP)


def fit(parts: Column, count: int) -> Column:
    """What ``cut`` gave, null without a match. If parts is a column of its own, the pattern isn't tried twice."""
    return F.when(F.size(parts) == count + 1, parts)


def fields(line: Column, pattern: str, count: int) -> Column:
    """As ``fit`` of ``cut``."""
    return fit(cut(line, pattern, count), count)


def pieces(text: Column, pattern: str, fields: list[str] | int) -> Column:
    """The fields of a pattern that has to begin where the text does, so that nothing is tried further on, and an empty one; another number of pieces if it doesn't fit. Fields are groups 1..n or may join groups, as "$1$2"."""
    wanted = [f"${k}" for k in range(1, fields + 1)] if isinstance(fields, int) else fields
    return F.split(F.regexp_replace(text, f"^(?:{pattern}).*$", _SEP.join(wanted) + _SEP), _SEP)


def number(text: Column, kind: str = "bigint") -> Column:
    """The number in a text; null for an empty or odd one."""
    return F.when(text != "", text).try_cast(kind)


def kib(value: Column, unit: Column) -> Column:
    """Whole KiB of a size and its unit letter."""
    factor = F.when(unit == "B", 1 / 1024).when(unit == "K", 1.0).when(unit == "M", 1024.0).when(unit == "G", 1048576.0)
    return F.floor(number(value, "double") * factor).cast("bigint")


def sizes(texts: Column) -> Column:
    """Whole KiB of each size with its unit letter, as doubles; null for an empty one."""
    return F.transform(texts, lambda x: kib(F.left(x, F.length(x) - 1), F.right(x, F.lit(1))).cast("double"))


def pool(before: Column, size_before: Column, after: Column, size_after: Column) -> Column:
    return F.struct(before.alias("occ_before"), size_before.alias("size_before"), after.alias("occ_after"), size_after.alias("size_after"))

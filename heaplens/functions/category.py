"""Categories of events: ordered rules over labels, the first that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern over the label, category), in order. Labels are those that the event parser gives.
CLASSIC = (
    (r"concurrent mode failure", "CMSConcurrentModeFailure"),
    (r"concurrent mode interrupted", "CMSConcurrentModeInterrupted"),
    (r"CMS-initial-mark|^Pause Initial Mark", "CMSInitialMark"),
    (r"CMS-remark|^Pause Remark", "CMSRemark"),
    (r"CMS-concurrent-abortable-preclean|^Concurrent Abortable Preclean", "CMSAbortablePreClean"),
    (r"CMS-concurrent-mark|^Concurrent Mark", "CMSConcurrentMark"),
    (r"CMS-concurrent-sweep|^Concurrent Sweep", "CMSConcurrentSweep"),
    (r"CMS-concurrent-preclean|^Concurrent Preclean", "CMSConcurrentPreClean"),
    (r"CMS-concurrent-reset|^Concurrent Reset", "CMSConcurrentReset"),
    (r"CMS-|^Concurrent ", "CMSUnknown"),
    (r"Full.*PSYoungGen", "PSFullGC"),
    (r"Full.*\(System(?:\.gc\(\))?\)?", "SystemGC"),
    (r"Full", "FullGC"),
    (r"ParNew \(promotion failed\)", "ParNewPromotionFailed"),
    (r"ParNew", "ParNew"),
    (r"PSYoungGen", "PSYoungGC"),
    (r"DefNew", "DefNew"),
    (r"^GC\b|^Pause Young", "YoungGC"),
)
G1 = (
    (r"^Pause Young.*\(Concurrent Start\)|^GC pause.*\(initial-mark\)|^Pause Young.*\(Initial Mark\)", "G1InitialMark"),
    (r"^Pause Young.*\(Mixed\)|^GC pause.*\(mixed\)|^Pause Mixed", "G1MixedGC"),
    (r"^Pause Young|^GC pause", "G1YoungGC"),
    (r"^Pause Cleanup|^GC cleanup", "G1Cleanup"),
    (r"^Pause Remark|^GC remark", "G1Remark"),
    (r"^Pause Full.*\(System\.gc\(\)\)|^Full GC \(System\.gc\(", "G1SystemGC"),
    (r"^Pause Full|^Full GC", "G1FullGC"),
    (r"^Concurrent Scan Root Regions?|^GC concurrent-root-region-scan", "G1ConcurrentScanRootRegion"),
    (r"^Concurrent Rebuild Remembered Sets", "G1ConcurrentRebuildRememberedSets"),
    (r"^Concurrent Mark Reset For Overflow", "G1ConcurrentMarkResetForOverflow"),
    (r"^Concurrent Create Live Data", "G1ConcurrentCreateLiveData"),
    (r"^Concurrent Complete Cleanup", "G1ConcurrentCompleteCleanup"),
    (r"^Concurrent Cleanup for Next Mark", "G1ConcurrentCleanupForNextMark"),
    (r"^Concurrent Undo Cycle", "G1ConcurrentUndoCycle"),
    (r"^Concurrent Mark(?: From Roots)?$|^Concurrent Mark |^GC concurrent-mark|^Concurrent Cycle|^Concurrent Mark Cycle", "G1ConcurrentMark"),
    (r"^Concurrent Cleanup|^GC concurrent-cleanup", "G1ConcurrentCleanup"),
    (r"^Concurrent String Deduplication|^GC concurrent-string-dedup", "G1ConcurrentStringDeduplication"),
    (r"^Concurrent Clear Claimed Marks", "G1ConcurrentClearClaimedMarks"),
)
ZGC = (
    (r"^Timer$", "ZGCTimer"),
    (r"^Warmup$", "ZGCWarmup"),
    (r"^Allocation Rate$", "ZGCAllocRate"),
    (r"^Allocation Stall$", "ZGCAllocStall"),
    (r"^Proactive$", "ZGCProactive"),
    (r"^Metadata GC Threshold$", "ZGCMetadataGCThreshold"),
    (r"^System\.gc\(\)$", "ZGCSystemGc"),
)


def _first(label: Column, rules, otherwise: str) -> Column:
    out = None
    for pattern, name in rules:
        out = F.when(label.rlike(pattern), name) if out is None else out.when(label.rlike(pattern), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def classic_category(label: Column) -> Column:
    return _first(label, CLASSIC, "Unknown")


def g1_category(label: Column) -> Column:
    return _first(label, G1, "G1Unknown")


def zgc_category(cause: Column) -> Column:
    return _first(cause, ZGC, "ZGCUnknown")


def category(family: Column, label: Column, families: tuple[str, ...] = ("g1", "zgc", "classic")) -> Column:
    """Category by family (classic, g1, zgc) and label; null for another family. ``families`` plans the rules of some only."""
    from ..registry import DIALECTS

    rules = {"g1": g1_category, "zgc": zgc_category, "classic": classic_category}
    rules |= {d.name: lambda label, d=d: _first(label, d.categories, d.otherwise) for d in DIALECTS.values()}
    out = F.lit(None).cast("string")
    for name in families:
        out = F.when(family == name, rules[name](label)).otherwise(out)
    return out


def is_pause(family: Column, label: Column) -> Column:
    """Concurrent phases aren't pauses; every cycle of the Z collector has its share of pause."""
    from ..registry import DIALECTS

    concurrent = label.rlike(r"^Concurrent |^CMS-concurrent-|^GC concurrent-") & ~label.rlike("concurrent mode")
    for d in DIALECTS.values():
        concurrent = F.when(family == d.name, label.rlike(d.concurrent) if d.concurrent else F.lit(False)).otherwise(concurrent)
    return F.when(family == "zgc", True).otherwise(~concurrent)

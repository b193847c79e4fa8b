"""Queries that go through all families, all categories, real files and the continuous job, beside those that look at one operator."""

from __future__ import annotations

import datetime
import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import aggregate as A
from ..operators import exposition
from ..operators.dialect import bounded, diary
from ..operators.events import parse_events
from ..operators.observations import asked, observe
from ..operators.rejects import outcomes, parse_with_rejects
from ..sources.lines import admit, list_files, match_names, probe_files, quarantined, read_heads, read_lines, write_texts
from . import synth
from .catalog import MMU_MS, ZGC_PHASES
from .queries import _FILES_SQL, _SUM, _files, _shared, _user, query

# Labels of unified G1 logs with their categories; those after the first eight are concurrent phases.
G1_LABELS = {
    "Pause Young (Normal) (G1 Evacuation Pause)": "G1YoungGC", "Pause Young (Concurrent Start) (G1 Humongous Allocation)": "G1InitialMark", "Pause Young (Mixed) (G1 Evacuation Pause)": "G1MixedGC", "Pause Cleanup": "G1Cleanup",
    "Pause Remark": "G1Remark", "Pause Full (System.gc())": "G1SystemGC", "Pause Full (G1 Compaction Pause)": "G1FullGC", "Pause Verify": "G1Unknown",
    "Concurrent Scan Root Regions": "G1ConcurrentScanRootRegion", "Concurrent Rebuild Remembered Sets": "G1ConcurrentRebuildRememberedSets", "Concurrent Mark Reset For Overflow": "G1ConcurrentMarkResetForOverflow",
    "Concurrent Create Live Data": "G1ConcurrentCreateLiveData", "Concurrent Complete Cleanup": "G1ConcurrentCompleteCleanup", "Concurrent Cleanup for Next Mark": "G1ConcurrentCleanupForNextMark", "Concurrent Undo Cycle": "G1ConcurrentUndoCycle",
    "Concurrent Mark": "G1ConcurrentMark", "Concurrent Cleanup": "G1ConcurrentCleanup", "Concurrent String Deduplication": "G1ConcurrentStringDeduplication", "Concurrent Clear Claimed Marks": "G1ConcurrentClearClaimedMarks",
}
ZGC_CAUSES = {
    "Timer": "ZGCTimer", "Warmup": "ZGCWarmup", "Allocation Rate": "ZGCAllocRate", "Allocation Stall": "ZGCAllocStall", "Proactive": "ZGCProactive", "Metadata GC Threshold": "ZGCMetadataGCThreshold", "System.gc()": "ZGCSystemGc", "High Usage": "ZGCUnknown",
}
# Lines of legacy logs with their categories; the last is a unified line.
CLASSIC_LINES = {
    "[Full GC (Allocation Failure) [CMS (concurrent mode failure): 9K->8K(90K), 0.1 secs] 9K->8K(99K), {} secs]": "CMSConcurrentModeFailure",
    "[Full GC (System.gc()) [CMS (concurrent mode interrupted): 9K->8K(90K), 0.1 secs] 9K->8K(99K), {} secs]": "CMSConcurrentModeInterrupted",
    "[GC (CMS Initial Mark) [1 CMS-initial-mark: 7K(70K)] 9K(99K), {} secs]": "CMSInitialMark",
    "[GC (CMS Final Remark) [1 CMS-remark: 7K(70K)] 9K(99K), {} secs]": "CMSRemark",
    "[CMS-concurrent-abortable-preclean: 0.001/{} secs]": "CMSAbortablePreClean",
    "[CMS-concurrent-mark: 0.001/{} secs]": "CMSConcurrentMark",
    "[CMS-concurrent-sweep: 0.001/{} secs]": "CMSConcurrentSweep",
    "[CMS-concurrent-preclean: 0.001/{} secs]": "CMSConcurrentPreClean",
    "[CMS-concurrent-reset: 0.001/{} secs]": "CMSConcurrentReset",
    "[Full GC (Ergonomics) [PSYoungGen: 5K->0K(9K)] [ParOldGen: 7K->6K(90K)] 12K->6K(99K), {} secs]": "PSFullGC",
    "[Full GC (System.gc()) [Tenured: 7K->6K(90K), 0.1 secs] 12K->6K(99K), {} secs]": "SystemGC",
    "[Full GC (Allocation Failure) [Tenured: 7K->6K(90K), 0.1 secs] 12K->6K(99K), {} secs]": "FullGC",
    "[GC (Allocation Failure) [ParNew (promotion failed): 5K->4K(9K), 0.1 secs] 12K->6K(99K), {} secs]": "ParNewPromotionFailed",
    "[GC (Allocation Failure) [ParNew: 5K->4K(9K), 0.1 secs] 12K->6K(99K), {} secs]": "ParNew",
    "[GC (Allocation Failure) [PSYoungGen: 5K->4K(9K)] 12K->6K(99K), {} secs]": "PSYoungGC",
    "[GC (Allocation Failure) [DefNew: 5K->4K(9K), 0.1 secs] 12K->6K(99K), {} secs]": "DefNew",
    "[GC (Allocation Failure)  12K->6K(99K), {} secs]": "YoungGC",
    "[Something else 12K->6K(99K), {} secs]": "Unknown",
    "Concurrent Something": "CMSUnknown",
}


def _pick(texts: list[str]) -> Column:
    """The text that event_id picks in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("event_id") % len(texts)).cast("int") + 1)


def _stamp(i: Column) -> Column:
    return F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSZ"), F.lit("][info][gc] "), F.format_string("GC(%d) ", i))


def g1_all(events: DataFrame) -> DataFrame:
    """Unified G1: every label in turn; pauses with regions of all spaces, metaspace with both sizes, and heap."""
    i, fmt = F.col("event_id"), F.format_string
    loud = (i % len(G1_LABELS)) < 8
    detail = lambda text: F.when(loud, F.concat(_stamp(i), text))
    spaces = [("Eden", 50, 7, 30), ("Survivor", 5, 6, 9), ("Old", 40, 41, 42), ("Humongous", 3, 2, 4), ("Archive", 8, 11, 12)]
    end = F.concat(_stamp(i), _pick(list(G1_LABELS)), F.when(loud, fmt(" %dM->%dM(512M)", 100 + i % 400, 10 + i % 90)).otherwise(""), fmt(" %.3fms", F.col("value")))
    body = [*(detail(fmt(f"{s} regions: %d->%d(%d)", i % a, i % b, i % c)) for s, a, b, c in spaces), detail(fmt("Metaspace: %dK(%dK)->%dK(%dK)", 1000 + i % 100, 2000 + i % 10, 1000 + i % 90, 4096 + i % 10)), end]
    return synth._lines(events, ["[0.010s][info][gc] Using G1", "[0.011s][info][gc,heap] Heap region size: 2M"], F.array(*body), "app")


def zgc_all(events: DataFrame) -> DataFrame:
    """Each cause in turn, with the last line of its cycle only."""
    i = F.col("event_id")
    line = F.concat(_stamp(i), F.format_string("Garbage Collection (%s) %dM(10%%)->%dM(9%%)", _pick(list(ZGC_CAUSES)), 100 + i % 90, 50 + i % 40))
    return synth._lines(events, ["[0.011s][info][gc] Using The Z Garbage Collector"], F.array(line), "zgc")


def classic_all(events: DataFrame) -> DataFrame:
    """Every line of ``CLASSIC_LINES`` in turn: legacy ones in one file of a user, the unified one in another."""
    i, n = F.col("event_id"), len(CLASSIC_LINES)
    secs = F.format_string("%.7f", F.col("value") / 1000)
    line = F.concat(F.format_string("%d.%03d: ", i, i % 1000), F.replace(_pick(list(CLASSIC_LINES)), F.lit("{}"), secs))
    old = synth._lines(events.where(i % n != n - 1), ["CommandLine flags: -XX:+UseConcMarkSweepGC"], F.array(line), "old")
    new = synth._lines(events.where(i % n == n - 1), ["[0.010s][info][gc] Using Concurrent Mark Sweep"], F.array(F.concat(_stamp(i), F.lit("Concurrent Something"), F.format_string(" %.3fms", F.col("value")))), "new")
    return old.unionByName(new)


_REFERENCES = ("SoftReference, %d refs, %.7f secs", "WeakReference, %d refs, %.7f secs", "FinalReference, %d refs, %.7f secs", "PhantomReference, %d refs, %d refs, %.7f secs", "JNI Weak Reference, %d refs, %.7f secs")


def _reference_text() -> Column:
    i = F.col("event_id")
    numbers = [i % 9, (i % 7) / 1e5, i % 11, (i % 6) / 1e5, i % 13, (i % 5) / 1e5, i % 5, i % 3, (i % 4) / 1e5, i % 17, (i % 3) / 1e5]
    return F.format_string("".join(f"[{x}]" for x in _REFERENCES), *numbers)


_REFERENCE_VALUES = {
    "soft_references": "event_id % 9", "soft_reference_pause_duration_seconds": "(event_id % 7) / 1e5", "weak_references": "event_id % 11", "weak_reference_pause_seconds": "(event_id % 6) / 1e5",
    "final_references": "event_id % 13", "final_reference_pause_duration_seconds": "(event_id % 5) / 1e5", "phantom_references": "event_id % 5", "free_phantom_references": "event_id % 3",
    "phantom_reference_pause_duration_seconds": "(event_id % 4) / 1e5", "jni_weak_references": "event_id % 17", "jni_weak_reference_pause_duration_seconds": "(event_id % 3) / 1e5",
}


def parallel_references(events: DataFrame) -> DataFrame:
    """Legacy Parallel with reference processing and metaspace in each line."""
    i, fmt = F.col("event_id"), F.format_string
    line = F.concat(
        fmt("%d.%03d: [GC (Allocation Failure) ", i, i % 1000), _reference_text(), fmt("[PSYoungGen: %dK->%dK(%dK)] ", 2000 + i % 900, i % 800, F.lit(40960)), fmt("%dK->%dK(%dK)", 9000 + i % 1000, 6000 + i % 500, F.lit(131072)),
        fmt(", [Metaspace: %dK->%dK(1064960K)], %.7f secs] [Times: user=0.01 sys=0.00, real=0.01 secs]", 3000 + i % 50, 3000 + i % 40, F.col("value") / 1000),
    )
    return synth._lines(events, ["CommandLine flags: -XX:+PrintGC -XX:+UseParallelGC"], F.array(line), "par")


def cms_remarks(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    times = F.format_string("[class unloading, %.7f secs][scrub symbol table, %.7f secs][scrub string table, %.7f secs][scrub symbol & string tables, %.7f secs]", (i % 9) / 1000, (i % 5) / 1000, (i % 4) / 1000, (i % 6) / 1000)
    line = F.concat(F.format_string("%d.%03d: [GC (CMS Final Remark) ", i, i % 1000), times, F.format_string("[1 CMS-remark: %dK(%dK)] %dK(%dK), %.7f secs]", 1000 + i % 500, F.lit(180224), 3000 + i % 700, F.lit(262144), F.col("value") / 1000))
    return synth._lines(events, ["CommandLine flags: -XX:+UseConcMarkSweepGC"], F.array(line), "cms")


def g1_blocks(events: DataFrame) -> DataFrame:
    """Legacy G1 blocks with reference processing and metaspace."""
    i, fmt = F.col("event_id"), F.format_string
    body = F.array(
        fmt("%d.%03d: [GC pause (G1 Evacuation Pause) (young), %.7f secs]", i, i % 1000, F.col("value") / 1000), F.concat(F.lit("   "), _reference_text()),
        fmt("   [Eden: %d.0K(%d.0M)->%d.0B(%d.0M) Survivors: %d.0K->%d.0K Heap: %d.5M(%d.0M)->%d.2K(%d.0M)]", i % 4000, 4 + i % 3, (i % 2) * 1024, 5 + i % 2, i % 77, i % 66, 1 + i % 200, F.lit(256), i % 9000, F.lit(320)),
        fmt("   [Metaspace: %dK->%dK(%dK)]", 3000 + i % 50, 3000 + i % 40, F.lit(1064960)), F.lit(" [Times: user=0.00 sys=0.00, real=0.00 secs] "),
    )
    return synth._lines(events, ["CommandLine flags: -XX:+UseG1GC"], body, "g1")


def _family_sql(values: dict[str, str], where: str = "true") -> str:
    """count, sum and last of each family's value, told from the columns of events."""
    one = "SELECT user_id, '{}' AS name, count(*) AS n, round(CAST(sum(CAST(v AS DECIMAL(38, 12))) AS DOUBLE), 6) AS total, round(arg_max(v, event_id), 9) AS last FROM (SELECT user_id, event_id, ({})::DOUBLE AS v FROM events WHERE {}) WHERE v IS NOT NULL GROUP BY user_id"
    return " UNION ALL ".join(one.format(name, expr, where) for name, expr in values.items())


def _family_state(spark: SparkSession, sf_dir: str, make, dialect: tuple[bool, str], names: dict[str, str]) -> DataFrame:
    # tens of families make methods that HotSpot never compiles (over 8000 bytes); those are left to smaller ones. The session keeps that
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    lines = make(synth.events_table(spark, sf_dir))
    state = A.metric_state(observe(parse_events(lines, diary(lines), [dialect], asked(set(names))), names=set(names)))
    return state.select(_user(), "name", "n", F.round("total", 6).alias("total"), F.round("last", 9).alias("last"))


_MB = lambda expr: f"({expr}) * 1048576"
_KB = lambda expr: f"({expr}) * 1024"
_REGION = lambda expr: f"({expr}) * 2097152"
_ABOVE = lambda expr, value: f"CASE WHEN {expr} > 0 THEN {value} END"

ZGC_VALUES = {f"zgc_{stem}": "value / 1000" if k == 1 else f"({k} + (event_id * {k + 1} % 1000) / 1000.0) / 1000" for k, (_, stem, _) in enumerate(ZGC_PHASES)}
ZGC_VALUES |= {"zgc_1m_cpu_load": "event_id % 8 + 0.25", "zgc_5m_cpu_load": "event_id % 9 + 0.5", "zgc_15m_cpu_load": "event_id % 10 + 0.75"}
ZGC_VALUES |= {f"zgc_{ms}ms_mmu_ratio": f"((event_id + {k}) % 100 + {k % 2 * 0.5}) / 100.0" for k, ms in enumerate(MMU_MS)}
# the snapshot at relocate end is that of relocate start, as in the catalog
for _k, _at in ((0, "mark_start"), (1, "mark_end"), (2, "relocate_start"), (2, "relocate_end")):
    ZGC_VALUES |= {f"zgc_{_at}_used_bytes": _MB(f"{100 * (_k + 1)} + event_id % 90"), f"zgc_{_at}_free_bytes": _MB(f"{900 - 100 * _k} - event_id % 90")}
for _kind, _low, _mod in (("live", 20, 30), ("allocated", 1, 20), ("garbage", 5, 25)):
    for _k, _at in enumerate(("mark_end", "reclaim_start", "reclaim_end")):
        _name = "zgc_garbage_reclaim_start_heap_bytes" if (_kind, _k) == ("garbage", 1) else f"zgc_{_kind}_{_at}_bytes"
        ZGC_VALUES[_name] = f"({_low + _k} + event_id % {_mod}) * {1024 if (_kind, _k) == ('live', 0) else 1048576}"
ZGC_VALUES |= {"zgc_reclaimed_reclaim_start_bytes": _MB("event_id % 15"), "zgc_reclaimed_reclaim_end_bytes": _MB("2 + event_id % 15"), "zgc_memory_reclaim_start_bytes": _MB("event_id % 16"), "zgc_memory_reclaim_end_bytes": _MB("3 + event_id % 16")}
ZGC_VALUES |= {"zgc_metaspace_used_bytes": _MB("10 + event_id % 5"), "zgc_metaspace_committed_bytes": _MB("24"), "zgc_metaspace_reserved_bytes": _MB("32")}

G1_VALUES = {f"g1_{s}_{word}_regions": f"event_id % {n}" for s, sizes in (("eden", (50, 7, 30)), ("survivor", (5, 6, 9)), ("old", (40, 41, 42)), ("humongous", (3, 2, 4)), ("archive", (8, 11, 12))) for word, n in zip(("before_collection", "after_collection", "assign"), sizes)}
G1_VALUES |= {
    "g1_eden_occupancy_after_collection_bytes": _REGION("event_id % 7"), "g1_eden_heap_occupancy_before_collection_bytes": _REGION("event_id % 50"), "g1_eden_size_after_collection_bytes": _ABOVE("event_id % 30", _REGION("event_id % 30")),
    "g1_survivor_heap_occupancy_after_collection_bytes": _REGION("event_id % 6"), "g1_survivor_heap_occupancy_before_collection_bytes": _REGION("event_id % 5"), "g1_survivor_size_bytes": _ABOVE("event_id % 9", _REGION("event_id % 9")),
    "young_occupancy_before_collection_bytes": _REGION("event_id % 50 + event_id % 5"), "young_occupancy_after_collection_bytes": _REGION("event_id % 7 + event_id % 6"),
    "young_size_before_collection_bytes": _REGION("event_id % 9"), "young_size_after_collection_bytes": _REGION("event_id % 30 + event_id % 9"),
    "metaspace_occupancy_before_collection_bytes": _KB("1000 + event_id % 100"), "metaspace_size_before_collection_bytes": _KB("2000 + event_id % 10"), "metaspace_occupancy_after_collection_bytes": _KB("1000 + event_id % 90"), "metaspace_size_after_collection_bytes": _KB("4096 + event_id % 10"),
    "heap_occupancy_before_collection_bytes": _MB("100 + event_id % 400"), "heap_size_before_collection_bytes": _MB("512"), "heap_occupancy_after_collection_bytes": _MB("10 + event_id % 90"), "heap_size_after_collection_bytes": _MB("512"),
}

G1_BLOCK_VALUES = _REFERENCE_VALUES | {
    "g1_eden_occupancy_after_collection_bytes": _KB("event_id % 2"), "g1_eden_heap_occupancy_before_collection_bytes": _KB("event_id % 4000"), "g1_eden_size_after_collection_bytes": _MB("5 + event_id % 2"), "g1_eden_size_before_collection_bytes": _MB("4 + event_id % 3"),
    "g1_survivor_heap_occupancy_after_collection_bytes": _KB("event_id % 66"), "g1_survivor_heap_occupancy_before_collection_bytes": _KB("event_id % 77"), "heap_size_before_collection_bytes": _MB("256"), "heap_size_after_collection_bytes": _MB("320"),
    "metaspace_occupancy_after_collection_bytes": _KB("3000 + event_id % 40"),
}

CLASSIC_VALUES = _REFERENCE_VALUES | {
    "heap_occupancy_before_collection_bytes": _KB("9000 + event_id % 1000"), "heap_size_before_collection_bytes": _KB("131072"), "heap_occupancy_after_collection_bytes": _KB("6000 + event_id % 500"), "heap_size_after_collection_bytes": _KB("131072"),
    "young_occupancy_before_collection_bytes": _KB("2000 + event_id % 900"), "young_size_before_collection_bytes": _KB("40960"), "young_occupancy_after_collection_bytes": _KB("event_id % 800"), "young_size_after_collection_bytes": _KB("40960"),
    "old_occupancy_before_collection_bytes": _KB("7000 + event_id % 1000 - event_id % 900"), "old_size_before_collection_bytes": _KB("90112"), "old_occupancy_after_collection_bytes": _KB("6000 + event_id % 500 - event_id % 800"), "old_size_after_collection_bytes": _KB("90112"),
    "metaspace_occupancy_before_collection_bytes": _KB("3000 + event_id % 50"), "metaspace_size_before_collection_bytes": _KB("1064960"), "metaspace_occupancy_after_collection_bytes": _KB("3000 + event_id % 40"), "metaspace_size_after_collection_bytes": _KB("1064960"),
}

CMS_VALUES = {
    "cms_class_unloading_process_duration_seconds": _ABOVE("event_id % 9", "(event_id % 9) / 1000"), "cms_symbol_table_process_duration_seconds": _ABOVE("event_id % 5", "(event_id % 5) / 1000"),
    "cms_string_table_process_duration_seconds": _ABOVE("event_id % 4", "(event_id % 4) / 1000"), "cms_symbol_and_string_table_process_seconds": _ABOVE("event_id % 6", "(event_id % 6) / 1000"),
    "old_occupancy_before_collection_bytes": _KB("1000 + event_id % 500"), "event_last_minute_pause_duration_seconds": "value / 1000",
}


@query(_family_sql(ZGC_VALUES))
def families_zgc(spark, sf_dir):
    return _family_state(spark, sf_dir, synth.unified_zgc, (True, "zgc"), ZGC_VALUES)


@query(_family_sql(G1_VALUES, f"event_id % {len(G1_LABELS)} < 8"))
def families_g1(spark, sf_dir):
    return _family_state(spark, sf_dir, g1_all, (True, "g1"), G1_VALUES)


@query(_family_sql(G1_BLOCK_VALUES))
def families_g1_legacy(spark, sf_dir):
    return _family_state(spark, sf_dir, g1_blocks, (False, "g1"), G1_BLOCK_VALUES)


@query(_family_sql(CLASSIC_VALUES))
def families_classic(spark, sf_dir):
    return _family_state(spark, sf_dir, parallel_references, (False, "classic"), CLASSIC_VALUES)


@query(_family_sql(CMS_VALUES))
def families_cms(spark, sf_dir):
    return _family_state(spark, sf_dir, cms_remarks, (False, "classic"), CMS_VALUES)


def _category_sql(names: list[str], pauses: str) -> str:
    return f"SELECT (['{"', '".join(names)}'])[event_id % {len(names)} + 1] AS category, count(*) AS n, count(*) FILTER ({pauses}) AS pauses FROM events GROUP BY 1"


def _categories(spark, sf_dir, make, dialects) -> DataFrame:
    lines = make(synth.events_table(spark, sf_dir))
    return parse_events(lines, diary(lines), dialects, ()).groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_pause").alias("pauses"))


@query(_category_sql(list(G1_LABELS.values()), f"event_id % {len(G1_LABELS)} < 8"))
def categories_g1_all(spark, sf_dir):
    return _categories(spark, sf_dir, g1_all, [(True, "g1")])


@query(_category_sql(list(ZGC_CAUSES.values()), "true"))
def categories_zgc_all(spark, sf_dir):
    return _categories(spark, sf_dir, zgc_all, [(True, "zgc")])


@query(_category_sql(list(CLASSIC_LINES.values()), f"event_id % {len(CLASSIC_LINES)} NOT BETWEEN 4 AND 8 AND event_id % {len(CLASSIC_LINES)} <> 18"))
def categories_classic_all(spark, sf_dir):
    return _categories(spark, sf_dir, classic_all, [(False, "classic"), (True, "classic")])


# Real files


def _written(spark, sf_dir) -> str:
    """Each user's unified G1 log as one text file, in folders by what divides the user's number."""
    folder, user = _shared(spark), F.regexp_extract("path", r"-(\d+)/", 1).cast("bigint")
    lines = synth.unified_g1(synth.events_table(spark, sf_dir)).withColumns({"even": (user % 2 == 0).cast("int"), "third": (user % 3 == 0).cast("int"), "user": user})
    if folder.startswith("file:"):
        # Spark's writer calls the system's chmod for each local file, its checksum and its folder, so tasks write local files themselves
        count = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = lines.repartition(count, "user").sortWithinPartitions("user", "split", "pos")
        write_texts(ordered.select("user", "line"), re.sub("^file:/*", "/", folder), lambda k: f"even={int(k % 2 == 0)}/third={int(k % 3 == 0)}/user={k}/part-00000.txt")
        return folder
    # the order begins with the folders: else the writer sorts by them anew, and beyond what its memory holds it loses the order of lines
    lines.repartition("user").sortWithinPartitions("even", "third", "user", "split", "pos").select("even", "third", "user", F.col("line").alias("value")).write.partitionBy("even", "third", "user").text(folder)
    return folder


def _file_user() -> Column:
    return F.regexp_extract("path", r"user=(\d+)/", 1).cast("bigint").alias("user_id")


@query("SELECT user_id, CASE event_type WHEN 'click' THEN 'G1YoungGC' WHEN 'view' THEN 'G1Remark' WHEN 'purchase' THEN 'G1SystemGC' WHEN 'signup' THEN 'G1ConcurrentMark' ELSE 'G1MixedGC' END AS category, count(*) AS n, "
       f"round({_SUM}, 6) AS total FROM events GROUP BY ALL")
def text_files_events(spark, sf_dir):
    """Through real files: a glob, lines, the diary from their heads, events."""
    lines = read_lines(spark, f"{_written(spark, sf_dir)}/even=*/third=*/user=*/*.txt")
    return parse_events(lines, diary(lines), [(True, "g1")], ("duration_s",)).groupBy(_file_user(), "category").agg(F.count("*").alias("n"), F.round(A._exact_sum(F.col("duration_s")), 6).alias("total"))


@query("SELECT user_id, 2 + sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END)::BIGINT AS n FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0 GROUP BY user_id")
def text_files_multi_glob(spark, sf_dir):
    """Two globs that overlap: each file counts once."""
    folder = _written(spark, sf_dir)
    files = list_files(spark, [f"{folder}/even=1/*/*/*.txt", f"{folder}/*/third=1/*/*.txt"])
    lines = read_lines(spark, [f"{folder}/even=1/*/*/*.txt", f"{folder}/even=0/third=1/*/*.txt"])
    return lines.join(bounded(files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))), "path", "left_semi").groupBy(_file_user()).agg(F.count("*").alias("n"))


@query("SELECT user_id, 1::BIGINT AS n FROM events WHERE user_id % 2 = 0 AND user_id % 3 = 0 AND user_id % 10 = 2 GROUP BY user_id")
def text_files_regex(spark, sf_dir):
    """A regular expression over the names of one folder, not of those below it."""
    folder = _written(spark, sf_dir)
    files = list_files(spark, f"{folder}/even=1/third=1/*/*.txt").withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))
    return match_names(files, re.sub("^file:/*", "/", f"{folder}/even=1/third=1"), r"user=\d*2").withColumn("path", F.concat("path", F.lit("/"))).groupBy(_file_user()).agg(F.count("*").alias("n"))


@query(f"WITH f AS ({_FILES_SQL}) SELECT path FROM f WHERE modified + INTERVAL 6 HOUR >= (SELECT max(modified) FROM f)")
def idle_admission(spark, sf_dir):
    files = _files(spark, sf_dir)
    return admit(files, files.agg(F.max("modified")).first()[0], idle_ms=6 * 3_600_000).select("path")


@query("SELECT 'startup_timestamp_seconds' AS name, 'here' AS host, NULL::VARCHAR AS version, true AS plausible UNION ALL SELECT 'exporter_version_info', 'here', '7', true")
def startup_and_version(spark, sf_dir):
    import time

    began = time.time()
    rows = A.info_gauges(diary(synth.unified_g1(synth.events_table(spark, sf_dir))), began, "7", "here").where("name <> 'collect_files'")
    ok = F.when(F.col("name") == "exporter_version_info", F.col("value") == 1).otherwise(F.abs(F.col("value") - F.unix_timestamp()) < 3600)
    return rows.select("name", F.col("labels.host").alias("host"), F.col("labels.version").alias("version"), ok.alias("plausible"))


# The continuous job


#: Rows of a micro-batch of a stream that is made from a table.
STREAM_ROWS = 1_500_000


def _by_time(rows: DataFrame, parts: int, folder: str) -> list[DataFrame]:
    """Rows with a time, in parts of about equal size, each later than the one before; they are read once and written to ``folder`` by part. The cuts come from a summary of bounded size."""
    spark, at = rows.sparkSession, F.unix_micros("ts")
    cuts = rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], F.lit(max(10_000, 20 * parts))).alias("cuts")).first().cuts
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= at)) if cuts else F.lit(0)
    rows.where("ts IS NOT NULL").withColumn("part", part).write.partitionBy("part").parquet(folder)
    written = spark.read.schema(StructType([*rows.schema.fields, StructField("part", IntegerType())])).parquet(folder)
    return [written.where(F.col("part") == k).drop("part") for k in range(len(cuts) + 1)]


def _stream(spark: SparkSession, parts: list[DataFrame]) -> tuple[DataFrame, str]:
    """A stream that gives one of the tables in each micro-batch, in several files each, and the folder it is in."""
    folder, files = _shared(spark), 4
    for df in parts:
        df.repartition(files).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


@query(f"""SELECT user_id, 'event_last_minute_duration_seconds' AS name, count(*) AS n, round({_SUM}, 6) AS total, arg_max(value, event_id) / 1000 AS last FROM events GROUP BY user_id
UNION ALL SELECT user_id, 'heap_occupancy_after_collection_bytes', count(*), (sum(10 + event_id % 90) * 1048576)::DOUBLE, (arg_max(10 + event_id % 90, event_id) * 1048576)::DOUBLE FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def continuous_job(spark, sf_dir):
    """The state of the job after three micro-batches that part in the middle of events."""
    from ..streaming.job import MetricJob

    lines = synth.unified_g1(synth.events_table(spark, sf_dir))
    cut = [F.col("pos") < 400_003, (F.col("pos") >= 400_003) & (F.col("pos") < 700_004), F.col("pos") >= 700_004]
    stream, folder = _stream(spark, [lines.where(c) for c in cut])
    job = MetricJob(spark, f"{folder}/state")
    query = job.start(stream, f"{folder}/checkpoint", availableNow=True)
    query.awaitTermination()
    names = ["event_last_minute_duration_seconds", "heap_occupancy_after_collection_bytes"]
    return job.state().where(F.col("name").isin(names)).select(_user(), "name", "n", F.round("total", 6).alias("total"), "last")


@query("""SELECT user_id, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, count(*) AS n, round(CAST(sum(CAST(value / 1000 AS DECIMAL(38, 12))) AS DOUBLE), 6) AS total FROM events GROUP BY ALL""")
def events_stream_tumbling(spark, sf_dir):
    """A stream of observations in order of time, summed by hour. The watermark lets windows go once they are behind it; each batch writes the windows that it changed, and the last row of each counts.

    A batch has at most some ``STREAM_ROWS`` observations (more only where so many are of one time), and with the watermark the state holds the windows of a batch and an hour, so that neither grows with the table.
    """
    lines = synth.unified_g1(synth.events_table(spark, sf_dir))
    own = _shared(spark)
    observed = f"{own}/observed"
    observe(parse_events(lines, diary(lines), [(True, "g1")], ("duration_s",)), names={"event_last_minute_duration_seconds"}).select("path", "ts", "value").write.parquet(observed)
    obs = spark.read.parquet(observed)
    stream, folder = _stream(spark, _by_time(obs, max(3, -(-obs.count() // STREAM_ROWS)), f"{own}/parts"))
    windows = stream.withWatermark("ts", "1 hour").groupBy(_user(), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(A._exact_sum(F.col("value")), 6).alias("total"))
    rows = windows.select("user_id", F.col("w.start").cast("bigint").alias("hour"), "n", "total")
    write = lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")
    rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.parquet(f"{folder}/out")
    return changed.groupBy("user_id", "hour").agg(F.max_by("n", "epoch").alias("n"), F.max_by("total", "epoch").alias("total"))


# Files: each once, heads, errors


@query("SELECT user_id, 2 + sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END)::BIGINT AS n FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0 GROUP BY user_id")
def text_files_overlapping_globs(spark, sf_dir):
    """Globs that overlap, repeat and hold braces, handed to the reader as they are: each file is read once."""
    folder = _written(spark, sf_dir)
    globs = [f"{folder}/even=1/*/*/*.txt", f"{folder}/*/third=1/*/*.txt", f"{folder}/even=1/**.txt", f"{folder}/even={{0,1}}/third=1/user=*/part-*", f"{folder}/even=1/*/*/*.txt"]
    return read_lines(spark, globs).groupBy(_file_user()).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id, 2 + sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END) AS n FROM events GROUP BY user_id)
SELECT user_id, least(n, 512)::BIGINT AS lines, 'g1' AS collector, true AS unified FROM l""")
def text_files_heads(spark, sf_dir):
    """The diary from the heads of files, which are all that is read of them."""
    heads = read_heads(spark, f"{_written(spark, sf_dir)}/**.txt")
    counts = heads.groupBy(_file_user()).agg(F.count("*").alias("lines"))
    return counts.join(diary(heads).select(_file_user(), "collector", "unified"), "user_id")


@query("""WITH l AS (SELECT user_id, user_id % 5 = 0 AS broken, 2 + sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END)::BIGINT AS n FROM events GROUP BY user_id)
SELECT user_id, broken AS failed, CASE WHEN NOT broken THEN least(n, 512)::BIGINT END AS lines, broken AS quarantined FROM l""")
def text_files_outcomes(spark, sf_dir):
    """Every fifth file's compression is broken: its error is a row that puts it in quarantine, and the others are read."""
    folder = _shared(spark)
    user = F.regexp_extract("path", r"-(\d+)/", 1).cast("bigint")
    lines = synth.unified_g1(synth.events_table(spark, sf_dir)).withColumn("user", user)
    good, broken = lines.where("user % 5 <> 0"), lines.where("user % 5 = 0")
    ordered = lambda df: df.repartition("user").sortWithinPartitions("user", "split", "pos").select("user", F.col("line").alias("value")).write.partitionBy("user")
    ordered(good).option("compression", "gzip").text(f"{folder}/good")
    ordered(broken).option("compression", "none").text(f"{folder}/plain")
    # plain text under a name that promises compression
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in list_files(spark, f"{folder}/plain/**.txt").select("path").collect():
        fs.rename(jvm.Path(row.path), jvm.Path(f"{row.path}.gz"))
    outcomes = probe_files(list_files(spark, [f"{folder}/good/**.gz", f"{folder}/plain/**.gz"]))
    now = datetime.datetime.now(datetime.timezone.utc)
    shut = quarantined(outcomes, now, most=10**6).select("path", F.lit(True).alias("quarantined"))
    return outcomes.join(shut, "path", "left").select(_file_user(), F.col("error").isNotNull().alias("failed"), F.when(F.col("head").isNotNull(), F.size("head")).cast("bigint").alias("lines"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))


# Quantiles from sketches


@query("""WITH w AS (SELECT user_id, value / 1000 AS v, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, date_trunc('millisecond', ts)) + INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, date_trunc('millisecond', ts)) + INTERVAL 60 MINUTE, INTERVAL 10 MINUTE)) AS window_end FROM events)
SELECT user_id, epoch(window_end)::BIGINT AS window_end, count(*) AS n, min(v) AS q0, max(v) AS q100, true AS close FROM w GROUP BY ALL""")
def sketch_quantiles_hop(spark, sf_dir):
    """Windows from rings of sketches: number, least and largest are exact, and the ranks of the quantiles between are off by at most 0.05 of what the window holds."""
    obs = observe(parse_events(lines := synth.unified_g1(synth.events_table(spark, sf_dir)), diary(lines), [(True, "g1")], ("duration_s",)), names={"event_last_minute_duration_seconds"})
    folder = _shared(spark)
    obs.select("name", "path", "host", "ts", "value").write.parquet(f"{folder}/observed")  # they are read three times
    obs = spark.read.parquet(f"{folder}/observed")
    A.hop_quantiles(obs, 3600).write.parquet(f"{folder}/windows")
    got = spark.read.parquet(f"{folder}/windows")
    ends = obs.select("path", "value", F.window("ts", "60 minutes", "10 minutes").getField("end").alias("window_end"))
    ranks = ends.join(got, ["path", "window_end"]).groupBy("path", "window_end").agg(*[F.struct(F.avg((F.col("value") < F.col(q)).cast("double")).alias("below"), F.avg((F.col("value") <= F.col(q)).cast("double")).alias("up_to")).alias(f"r{q}") for q in ("q50", "q75")])
    close = lambda q, rank: (F.col(f"r{q}.below") <= rank + 0.05) & (F.col(f"r{q}.up_to") >= rank - 0.05)
    return got.join(ranks, ["path", "window_end"]).select(_user(), F.col("window_end").cast("bigint").alias("window_end"), "n", "q0", "q100", (close("q50", 0.5) & close("q75", 0.75)).alias("close"))


# Lines by what became of them


@query("""SELECT user_id, 'taken' AS outcome, NULL::VARCHAR AS reason, count(*) FILTER (event_id % 4 <> 0 AND user_id % 6 < 5) AS n FROM events GROUP BY user_id HAVING n > 0
UNION ALL SELECT user_id, 'rejected', 'no rule', count(*) FILTER (event_id % 4 = 0 AND event_id % 8 <> 0) + 1 FROM events WHERE user_id % 6 < 5 GROUP BY user_id
UNION ALL SELECT user_id, 'rejected', 'unsupported file', count(*) FILTER (event_id % 8 <> 0) AS n FROM events WHERE user_id % 6 = 5 GROUP BY user_id HAVING n > 0
UNION ALL SELECT user_id, 'blank', NULL, count(*) FILTER (event_id % 8 = 0) AS n FROM events GROUP BY user_id HAVING n > 0""")
def line_outcomes(spark, sf_dir):
    """Each line is taken, blank or rejected for a reason: of each file every fourth line is cut in the middle, every eighth is blank, and every sixth file is of no known dialect."""
    lines = synth.legacy_parallel(synth.events_table(spark, sf_dir))
    k = F.when(F.col("pos") >= 0, F.col("pos") / 100)
    user = F.regexp_extract("path", r"-(\d+)/", 1).cast("bigint")
    line = F.when(k % 8 == 0, "  ").when(user % 6 == 5, F.concat(F.lit("request "), F.substring("line", 1, 20))).when(k % 4 == 0, F.substring("line", 1, 70)).otherwise(F.col("line"))
    lines = lines.where((user % 6 != 5) | (F.col("pos") >= 0)).withColumn("line", line)
    return outcomes(lines, diary(lines)).groupBy(_user(), "outcome", "reason").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (event_id % 4 <> 0) AS events, count(*) FILTER (event_id % 4 = 0) + count(DISTINCT user_id) AS rejects, count(*) + count(DISTINCT user_id) AS lines FROM events""")
def events_and_rejects(spark, sf_dir):
    """One call gives both the events and the lines that no rule took; together they are all lines."""
    lines = synth.legacy_parallel(synth.events_table(spark, sf_dir))
    lines = lines.withColumn("line", F.when((F.col("pos") >= 0) & (F.col("pos") / 100 % 4 == 0), F.substring("line", 1, 70)).otherwise(F.col("line")))
    events, rejects = parse_with_rejects(lines, diary(lines), [(False, "classic")])
    told = [events.select(F.lit("events").alias("what")), rejects.select(F.lit("rejects").alias("what")), lines.select(F.lit("lines").alias("what"))]
    counted = told[0].unionByName(told[1]).unionByName(told[2])
    return counted.agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("events", "rejects", "lines")])


# The page in OpenMetrics


@query("""WITH l AS (SELECT user_id, 2 + sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END) AS n FROM events GROUP BY user_id)
SELECT 'gc_log_lines_total' AS family, 'gc_log_lines_total{host="localhost",path="/var/log/app-' || user_id || '/gc.log"} ' || n || '.0' AS line FROM l
UNION ALL SELECT 'gc_log_lines_total', '# TYPE gc_log_lines counter' UNION ALL SELECT 'gc_log_lines_total', '# HELP gc_log_lines gc log lines' UNION ALL SELECT '', '# EOF'""")
def openmetrics_page(spark, sf_dir):
    lines = synth.unified_g1(synth.events_table(spark, sf_dir))
    none = spark.createDataFrame([], "name string, path string, host string, category string, n bigint, total double, last double, split bigint, pos bigint")
    return exposition.render(A.samples(none, lines), openmetrics=True)


# SQL views over files


@query(f"""SELECT 'gc_startup_timestamp_seconds' AS name, 1::BIGINT AS n, true AS plausible UNION ALL SELECT 'gc_collect_files', count(DISTINCT user_id), true FROM events
UNION ALL SELECT 'gc_log_lines_total', count(DISTINCT user_id), true FROM events UNION ALL SELECT 'gc_event_duration_seconds_count', count(DISTINCT (user_id, event_type)), true FROM events""")
def sql_views_samples(spark, sf_dir):
    """The views that SQL sees over real files, with the start time of the session that registered them."""
    from ..sql import register

    register(spark, f"{_written(spark, sf_dir)}/**.txt")
    return spark.sql("""SELECT name, count(*) AS n, bool_and(name <> 'gc_startup_timestamp_seconds' OR abs(value - unix_timestamp()) < 3600) AS plausible FROM gc_samples
        WHERE name IN ('gc_startup_timestamp_seconds', 'gc_collect_files', 'gc_log_lines_total', 'gc_event_duration_seconds_count') GROUP BY name""")


@query("""SELECT user_id, category, count(*) AS n, round(max(value) / 1000, 6) AS longest FROM (
SELECT user_id, value, CASE event_type WHEN 'click' THEN 'G1YoungGC' WHEN 'view' THEN 'G1Remark' WHEN 'purchase' THEN 'G1SystemGC' WHEN 'signup' THEN 'G1ConcurrentMark' ELSE 'G1MixedGC' END AS category FROM events) GROUP BY ALL""")
def sql_views_events(spark, sf_dir):
    """The table of events in SQL."""
    from ..sql import register

    register(spark, f"{_written(spark, sf_dir)}/even=*/third=*/user=*/part-*")
    return spark.sql(r"SELECT CAST(regexp_extract(path, 'user=([0-9]+)/', 1) AS BIGINT) AS user_id, category, count(*) AS n, round(max(duration_s), 6) AS longest FROM gc_events GROUP BY ALL")

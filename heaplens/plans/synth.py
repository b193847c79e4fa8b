"""Log lines made from the driver's ``events`` table, so that results of the parser can be told from the table's columns.

Every event becomes the lines that a JVM would have logged for it; numbers follow from event_id and value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = "localhost"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that lines are made of. A row becomes up to thirty lines, so rows of fewer files than there are cores are first dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def path(kind: str = "app") -> Column:
    return F.concat(F.lit(f"/var/log/{kind}-"), F.col("user_id").cast("string"), F.lit("/gc.log"))


def _fmt(template: str, *args: Column) -> Column:
    """As ``format_string``, which is left to numbers of a given width or precision: it reads its template anew for each row."""
    left, parts = iter(args), []
    for piece in re.split(r"(%[^a-z%]*[dfs%])", template):
        if piece in ("%d", "%s"):
            parts.append(F.coalesce(next(left).cast("string"), F.lit("null")))
        elif piece == "%%":
            parts.append(F.lit("%"))
        elif piece:
            parts.append(F.format_string(piece, next(left)) if piece[0] == "%" else F.lit(piece))
    return F.concat(*parts)


def _lines(events: DataFrame, head: list[str], body: Column, kind: str) -> DataFrame:
    """Head lines once for each path (before all others), then the lines of each event in order."""
    heads = events.select(path(kind).alias("path")).distinct().select("path", F.posexplode(F.array(*[F.lit(x) for x in head])).alias("k", "line"))
    heads = heads.select("path", F.lit(HOST).alias("host"), F.lit(0).cast("bigint").alias("split"), (F.col("k") - 1000).cast("bigint").alias("pos"), "line")
    rows = events.select(path(kind).alias("path"), F.lit(HOST).alias("host"), F.lit(0).cast("bigint").alias("split"), "event_id", F.posexplode(F.filter(body, lambda x: x.isNotNull())).alias("k", "line"))
    return heads.unionByName(rows.select("path", "host", "split", (F.col("event_id") * 100 + F.col("k")).alias("pos"), "line"))


# The label that each type of event gets in unified G1 logs.
G1_LABELS = {"click": "Pause Young (Normal) (G1 Evacuation Pause)", "view": "Pause Remark", "purchase": "Pause Full (System.gc())", "signup": "Concurrent Mark", "error": "Pause Young (Mixed) (G1 Evacuation Pause)"}


def _label(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("event_type")]


def _stamped(events: DataFrame) -> DataFrame:
    """With what begins each unified line of an event, written once for all of them."""
    return events.withColumn("stamp", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSZ"), F.lit("][info][gc] "), _fmt("GC(%d) ", F.col("event_id"))))


def unified_g1(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    events, gc = _stamped(events), F.col("stamp")
    quiet = F.col("event_type") == "signup"
    loud = lambda text: F.when(~quiet, F.concat(gc, text))
    body = F.array(
        loud(_fmt("Eden regions: %d->%d(%d)", i % 50, i % 7, i % 30)), loud(_fmt("Survivor regions: %d->%d(%d)", i % 5, i % 6, i % 9)), loud(_fmt("Old regions: %d->%d", i % 40, i % 41)), loud(_fmt("Humongous regions: %d->%d", i % 3, i % 2)),
        loud(_fmt("Metaspace: %dK->%dK(%dK)", 1000 + i % 100, 1000 + i % 90, 4096 + i % 10)),
        F.concat(gc, F.when(quiet, _fmt("%s %.3fms", _label(G1_LABELS), F.col("value"))).otherwise(_fmt("%s %dM->%dM(512M) %.3fms", _label(G1_LABELS), 100 + i % 400, 10 + i % 90, F.col("value")))),
        F.concat(gc, F.lit("User=0.01s Sys=0.00s Real=0.00s")),
    )
    return _lines(events, ["[0.010s][info][gc] Using G1", "[0.011s][info][gc,heap] Heap region size: 2M"], body, "app")


PARALLEL_LABELS = {"click": "GC (Allocation Failure) ", "view": "GC (Metadata GC Threshold) ", "purchase": "Full GC (System.gc()) ", "signup": "GC (GCLocker Initiated GC) ", "error": "Full GC (Ergonomics) "}


def legacy_parallel(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    full = F.col("event_type").isin("purchase", "error")
    old = F.when(full, _fmt("[ParOldGen: %dK->%dK(%dK)] ", 5000 + i % 700, 4000 + i % 600, F.lit(90000))).otherwise("")
    meta = F.when(full, _fmt(", [Metaspace: %dK->%dK(1064960K)]", 3000 + i % 50, 3000 + i % 50)).otherwise("")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSZ"), _fmt(": %d.%03d: [", i, i % 1000), _label(PARALLEL_LABELS), _fmt("[PSYoungGen: %dK->%dK(%dK)] ", 2000 + i % 900, i % 800, F.lit(40960)), old,
        _fmt("%dK->%dK(%dK)", 9000 + i % 1000, 6000 + i % 500, F.lit(131072)), meta, _fmt(", %.7f secs] [Times: user=0.01 sys=0.00, real=0.01 secs]", F.col("value") / 1000),
    )
    return _lines(events, ["CommandLine flags: -XX:+PrintGC -XX:+UseParallelGC"], F.array(line), "par")


def legacy_cms(events: DataFrame) -> DataFrame:
    i, secs = F.col("event_id"), F.col("value") / 1000
    kind = F.col("event_type")
    cpu = _fmt("%d.%03d: ", i, i % 1000)
    line = (
        F.when(kind == "click", _fmt("[GC (Allocation Failure) [ParNew: %dK->%dK(81920K), %.7f secs] %dK->%dK(262144K), %.7f secs] [Times: user=0.03 sys=0.01, real=0.01 secs]", 70000 + i % 900, i % 800, secs, 90000 + i % 1000, 60000 + i % 500, secs))
        .when(kind == "view", _fmt("[GC (CMS Initial Mark) [1 CMS-initial-mark: %dK(180224K)] %dK(262144K), %.7f secs] [Times: user=0.00 sys=0.00, real=0.00 secs]", 1000 + i % 500, 3000 + i % 700, secs))
        .when(kind == "purchase", _fmt("[GC (CMS Final Remark) [YG occupancy: 1 K (2 K)][class unloading, %.7f secs][scrub symbol table, %.7f secs][scrub string table, 0.0000000 secs][1 CMS-remark: %dK(180224K)] %dK(262144K), %.7f secs] [Times: user=0.01 sys=0.00, real=0.00 secs]", (i % 9) / 1000, (i % 5) / 1000, 1000 + i % 500, 3000 + i % 700, secs))
        .when(kind == "signup", _fmt("[CMS-concurrent-sweep: %.3f/%.7f secs]", secs, secs))
        .otherwise(_fmt("[Full GC (Allocation Failure) %d.1: [CMS (concurrent mode failure): %dK->%dK(180224K), %.7f secs] %dK->%dK(262144K), [Metaspace: 3000K->3000K(1064960K)], %.7f secs] [Times: user=0.01 sys=0.00, real=0.01 secs]", i, 1000 + i % 500, i % 400, secs, 9000 + i % 1000, 6000 + i % 500, secs))
    )
    return _lines(events, ["CommandLine flags: -XX:+UseConcMarkSweepGC -XX:+UseParNewGC"], F.array(F.concat(cpu, line)), "cms")


G1_LEGACY = {"click": "GC pause (G1 Evacuation Pause) (young)", "view": "GC remark", "purchase": "Full GC (System.gc())", "signup": "GC pause (G1 Humongous Allocation) (young) (initial-mark)", "error": "GC pause (G1 Evacuation Pause) (mixed)"}


def legacy_g1(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    brief = F.col("event_type") == "view"
    body = F.array(
        F.concat(_fmt("%d.%03d: [", i, i % 1000), _label(G1_LEGACY), _fmt(", %.7f secs]", F.col("value") / 1000)),
        F.when(~brief, F.lit("   [Parallel Time: 0.3 ms, GC Workers: 8]")),
        F.when(~brief, _fmt("   [Eden: %d.0K(%d.0M)->0.0B(%d.0M) Survivors: %d.0K->%d.0K Heap: %d.5M(%d.0M)->%d.2K(%d.0M)]", i % 4000, 4 + i % 3, 5 + i % 2, i % 77, i % 66, 1 + i % 200, F.lit(256), i % 9000, F.lit(256))),
        F.lit(" [Times: user=0.00 sys=0.00, real=0.00 secs] "),
    )
    return _lines(events, ["CommandLine flags: -XX:+UseG1GC"], body, "g1")


ZGC_CAUSES = {"click": "Allocation Rate", "view": "Timer", "purchase": "System.gc()", "signup": "Warmup", "error": "Allocation Stall"}


def unified_zgc(events: DataFrame) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    m = lambda *xs: [F.lit(x) if isinstance(x, int) else x for x in xs]
    phases = ["Pause Mark Start", "Concurrent Mark", "Concurrent Mark Free", "Pause Mark End", "Concurrent Process Non-Strong References", "Concurrent Reset Relocation Set", "Concurrent Select Relocation Set", "Pause Relocate Start", "Concurrent Relocate"]
    times = [_fmt(f"{name} %d.%03dms", F.lit(k), (i * (k + 1)) % 1000) if name != "Concurrent Mark" else _fmt("Concurrent Mark %.3fms", v) for k, name in enumerate(phases)]
    body = [
        _fmt("Garbage Collection (%s)", _label(ZGC_CAUSES)), *times,
        _fmt("Load: %d.25/%d.50/%d.75", i % 8, i % 9, i % 10),
        _fmt("MMU: 2ms/%d.0%%, 5ms/%d.5%%, 10ms/%d.0%%, 20ms/%d.5%%, 50ms/%d.0%%, 100ms/%d.5%%", *[(i + k) % 100 for k in range(6)]),
        _fmt("Metaspace: %dM used, %dM capacity, %dM committed, %dM reserved", 10 + i % 5, *m(20, 24, 32)),
        _fmt("     Used:     %dM (1%%)     %dM (2%%)     %dM (3%%)     %dM (4%%)     900M (9%%)     1M (0%%)", *[100 * (k + 1) + i % 90 for k in range(4)]),
        _fmt("     Free:     %dM (1%%)     %dM (2%%)     %dM (3%%)     %dM (4%%)     900M (9%%)     1M (0%%)", *[900 - 100 * k - i % 90 for k in range(4)]),
        _fmt("     Live:         -          %dM (5%%)      %dM (5%%)      %dM (5%%)          -          -", *[20 + i % 30 + k for k in range(3)]),
        _fmt("Allocated:         -          %dM (0%%)      %dM (1%%)      %dM (1%%)          -          -", *[1 + i % 20 + k for k in range(3)]),
        _fmt("  Garbage:         -          %dM (0%%)      %dM (1%%)      %dM (1%%)          -          -", *[5 + i % 25 + k for k in range(3)]),
        _fmt("Reclaimed:         -          -          %dM (1%%)      %dM (2%%)          -          -", i % 15, 2 + i % 15),
        _fmt("   Memory:         -          -          %dM (1%%)      %dM (2%%)          -          -", i % 16, 3 + i % 16),
        _fmt("Garbage Collection (%s) %dM(10%%)->%dM(9%%)", _label(ZGC_CAUSES), 100 + i % 90, 50 + i % 40),
    ]
    return _lines(_stamped(events), ["[0.010s][info][gc,init] Initializing The Z Garbage Collector", "[0.011s][info][gc] Using The Z Garbage Collector"], F.array(*[F.concat("stamp", x) for x in body]), "zgc")

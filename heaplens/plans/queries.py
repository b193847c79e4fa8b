"""Queries over lines made from the driver's tables, with SQL that tells the answer from the tables themselves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import aggregate as A
from ..operators import exposition
from ..operators.dialect import diary, head_lines
from ..operators.events import parse_events
from ..operators.observations import asked, observe
from . import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DIALECTS = {synth.unified_g1: (True, "g1"), synth.unified_zgc: (True, "zgc"), synth.legacy_parallel: (False, "classic"), synth.legacy_cms: (False, "classic"), synth.legacy_g1: (False, "g1")}


def _events(spark: SparkSession, sf_dir: str, make=synth.unified_g1, columns: Collection[str] | None = None) -> DataFrame:
    lines = make(synth.events_table(spark, sf_dir))
    return parse_events(lines, diary(lines), [_DIALECTS[make]], columns)


def _observed(spark: SparkSession, sf_dir: str, names: set[str], make=synth.unified_g1) -> DataFrame:
    return observe(_events(spark, sf_dir, make, asked(names)), names=names)


def _shared(spark: SparkSession) -> str:
    """A new folder in the shared one; where none is set (tests on one machine), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set")
        folder = "file://" + tempfile.mkdtemp(prefix="heaplens-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def _user(column: str = "path"):
    return F.regexp_extract(column, r"-(\d+)/", 1).cast("bigint").alias("user_id")


def _state(spark, sf_dir, names: set[str], make=synth.unified_g1) -> DataFrame:
    return A.metric_state(_observed(spark, sf_dir, names, make))


def _last(spark, sf_dir, names: dict[str, str], make=synth.unified_g1) -> DataFrame:
    """user_id and the last value of each family, one column each."""
    state = _state(spark, sf_dir, set(names), make)
    cols = [F.max(F.when(F.col("name") == n, F.col("last"))).alias(c) for n, c in names.items()]
    return state.groupBy(_user()).agg(*cols)


_G1_CATEGORY = "CASE event_type WHEN 'click' THEN 'G1YoungGC' WHEN 'view' THEN 'G1Remark' WHEN 'purchase' THEN 'G1SystemGC' WHEN 'signup' THEN 'G1ConcurrentMark' ELSE 'G1MixedGC' END"
_SUM = "CAST(sum(CAST(value / 1000 AS DECIMAL(38, 12))) AS DOUBLE)"


@query("SELECT '/var/log/app-' || user_id || '/gc.log' AS path, CAST(sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END) + 2 AS DOUBLE) AS value FROM events GROUP BY user_id")
def log_lines_total(spark, sf_dir):
    return A.log_lines(synth.unified_g1(synth.events_table(spark, sf_dir))).select("path", "value")


@query(f"SELECT user_id, {_G1_CATEGORY} AS category, count(*) AS n, round({_SUM}, 6) AS total FROM events GROUP BY ALL")
def event_duration_summary(spark, sf_dir):
    return _state(spark, sf_dir, {"event_duration_seconds"}).select(_user(), "category", "n", F.round("total", 6).alias("total"))


@query(f"SELECT user_id, {_G1_CATEGORY} AS category, count(*) AS n, round({_SUM}, 6) AS total FROM events WHERE event_type <> 'signup' GROUP BY ALL")
def event_pause_duration_summary(spark, sf_dir):
    return _state(spark, sf_dir, {"event_pause_duration_seconds"}).select(_user(), "category", "n", F.round("total", 6).alias("total"))


@query("""SELECT user_id, CAST((100 + event_id % 400) * 1048576 AS DOUBLE) AS before, CAST((10 + event_id % 90) * 1048576 AS DOUBLE) AS after, CAST(512 * 1048576 AS DOUBLE) AS size
FROM events WHERE event_type <> 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def heap_gauges_last(spark, sf_dir):
    return _last(spark, sf_dir, {"heap_occupancy_before_collection_bytes": "before", "heap_occupancy_after_collection_bytes": "after", "heap_size_after_collection_bytes": "size"})


@query("""SELECT user_id, CAST(arg_max(event_id % 50, event_id) * 2097152 AS DOUBLE) AS occupancy, CAST(arg_max(event_id % 5, event_id) * 2097152 AS DOUBLE) AS survivors
FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def gauge_nonneg_guard(spark, sf_dir):
    return _last(spark, sf_dir, {"g1_eden_heap_occupancy_before_collection_bytes": "occupancy", "g1_survivor_heap_occupancy_before_collection_bytes": "survivors"})


@query("""SELECT user_id, CAST(arg_max(event_id % 30, event_id) FILTER (event_id % 30 > 0) * 2097152 AS DOUBLE) AS eden_size, CAST(arg_max(event_id % 9, event_id) FILTER (event_id % 9 > 0) * 2097152 AS DOUBLE) AS survivor_size
FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def gauge_positive_guard(spark, sf_dir):
    return _last(spark, sf_dir, {"g1_eden_size_after_collection_bytes": "eden_size", "g1_survivor_size_bytes": "survivor_size"})


@query("""SELECT user_id, CAST(arg_max(event_id % 50 + event_id % 5, event_id) * 2097152 AS DOUBLE) AS before, CAST(arg_max(event_id % 7 + event_id % 6, event_id) * 2097152 AS DOUBLE) AS after,
CAST(arg_max(event_id % 30 + event_id % 9, event_id) * 2097152 AS DOUBLE) AS size_after, CAST(arg_max(event_id % 9, event_id) * 2097152 AS DOUBLE) AS size_before FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def g1_young_derived(spark, sf_dir):
    return _last(spark, sf_dir, {"young_occupancy_before_collection_bytes": "before", "young_occupancy_after_collection_bytes": "after", "young_size_after_collection_bytes": "size_after", "young_size_before_collection_bytes": "size_before"})


@query("""SELECT user_id, CAST(arg_max(event_id % 50, event_id) AS DOUBLE) AS eden_before, CAST(arg_max(event_id % 6, event_id) AS DOUBLE) AS survivor_after, CAST(arg_max(event_id % 40, event_id) AS DOUBLE) AS old_before,
CAST(arg_max(event_id % 2, event_id) AS DOUBLE) AS humongous_after, CAST(arg_max(event_id % 30, event_id) AS DOUBLE) AS eden_assigned FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def g1_regions_last(spark, sf_dir):
    return _last(spark, sf_dir, {"g1_eden_before_collection_regions": "eden_before", "g1_survivor_after_collection_regions": "survivor_after", "g1_old_before_collection_regions": "old_before", "g1_humongous_after_collection_regions": "humongous_after", "g1_eden_assign_regions": "eden_assigned"})


@query("""SELECT user_id, CAST(arg_max(1000 + event_id % 100, event_id) * 1024 AS DOUBLE) AS before, CAST(arg_max(1000 + event_id % 90, event_id) * 1024 AS DOUBLE) AS after, CAST(arg_max(4096 + event_id % 10, event_id) * 1024 AS DOUBLE) AS size
FROM events WHERE event_type <> 'signup' GROUP BY user_id""")
def g1_metaspace_last(spark, sf_dir):
    return _last(spark, sf_dir, {"metaspace_occupancy_before_collection_bytes": "before", "metaspace_occupancy_after_collection_bytes": "after", "metaspace_size_after_collection_bytes": "size"})




@query("""WITH p AS (SELECT *, (event_id % 1000) / 1000.0 AS a, 3 + (event_id * 4 % 1000) / 1000.0 AS b, 7 + (event_id * 8 % 1000) / 1000.0 AS c,
value + 2 + (event_id * 3 % 1000) / 1000.0 + 4 + (event_id * 5 % 1000) / 1000.0 + 5 + (event_id * 6 % 1000) / 1000.0 + 6 + (event_id * 7 % 1000) / 1000.0 + 8 + (event_id * 9 % 1000) / 1000.0 AS rest FROM events)
SELECT user_id, count(*) AS n, round(sum(a + b + c + rest) / 1000, 6) AS total, round(sum(a + b + c) / 1000, 6) AS paused, round(sum(value) / 1000, 6) AS marked FROM p GROUP BY user_id""")
def zgc_phase_totals(spark, sf_dir):
    state = _state(spark, sf_dir, {"event_last_minute_duration_seconds", "event_last_minute_pause_duration_seconds", "zgc_concurrent_mark_duration_seconds"}, synth.unified_zgc)
    pick = lambda name: F.round(F.max(F.when(F.col("name") == name, F.col("total"))), 6)
    return state.groupBy(_user()).agg(F.max("n").alias("n"), pick("event_last_minute_duration_seconds").alias("total"), pick("event_last_minute_pause_duration_seconds").alias("paused"), pick("zgc_concurrent_mark_duration_seconds").alias("marked"))


@query("""SELECT user_id, CAST(1000 * 1048576 AS DOUBLE) AS size_before, CAST(arg_max(100 + event_id % 90, event_id) * 1048576 AS DOUBLE) AS before, CAST(1000 * 1048576 AS DOUBLE) AS size_after,
CAST(arg_max(300 + event_id % 90, event_id) * 1048576 AS DOUBLE) AS after, CAST(arg_max(20 + event_id % 30, event_id) * 1024 AS DOUBLE) AS live_mark_end, CAST(arg_max(23 - 2 + event_id % 30, event_id) * 1048576 AS DOUBLE) AS live_reclaim_start,
CAST(arg_max(2 + event_id % 15, event_id) * 1048576 AS DOUBLE) AS reclaimed, CAST(arg_max(10 + event_id % 5, event_id) * 1048576 AS DOUBLE) AS metaspace_used FROM events GROUP BY user_id""")
def zgc_heap_size(spark, sf_dir):
    return _last(spark, sf_dir, {"heap_size_before_collection_bytes": "size_before", "heap_occupancy_before_collection_bytes": "before", "heap_size_after_collection_bytes": "size_after", "heap_occupancy_after_collection_bytes": "after", "zgc_live_mark_end_bytes": "live_mark_end", "zgc_live_reclaim_start_bytes": "live_reclaim_start", "zgc_reclaimed_reclaim_end_bytes": "reclaimed", "zgc_metaspace_used_bytes": "metaspace_used"}, synth.unified_zgc)


@query("""SELECT user_id, arg_max(event_id % 8 + 0.25, event_id)::DOUBLE AS load1, arg_max(event_id % 10 + 0.75, event_id)::DOUBLE AS load15, round((arg_max(event_id % 100, event_id) / 100.0)::DOUBLE, 9) AS mmu2, round((arg_max((event_id + 5) % 100 + 0.5, event_id) / 100.0)::DOUBLE, 9) AS mmu100
FROM events GROUP BY user_id""")
def zgc_mmu_load_last(spark, sf_dir):
    rows = _last(spark, sf_dir, {"zgc_1m_cpu_load": "load1", "zgc_15m_cpu_load": "load15", "zgc_2ms_mmu_ratio": "mmu2", "zgc_100ms_mmu_ratio": "mmu100"}, synth.unified_zgc)
    return rows.withColumns({"mmu2": F.round("mmu2", 9), "mmu100": F.round("mmu100", 9)})


def _category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_pause").alias("pauses"))


@query(f"SELECT {_G1_CATEGORY} AS category, count(*) AS n, count(*) FILTER (event_type <> 'signup') AS pauses FROM events GROUP BY 1")
def category_g1(spark, sf_dir):
    return _category_counts(_events(spark, sf_dir, columns=()))


@query("""SELECT CASE event_type WHEN 'click' THEN 'ParNew' WHEN 'view' THEN 'CMSInitialMark' WHEN 'purchase' THEN 'CMSRemark' WHEN 'signup' THEN 'CMSConcurrentSweep' ELSE 'CMSConcurrentModeFailure' END AS category,
count(*) AS n, count(*) FILTER (event_type <> 'signup') AS pauses FROM events GROUP BY 1""")
def category_classic(spark, sf_dir):
    return _category_counts(_events(spark, sf_dir, synth.legacy_cms))


@query("""SELECT CASE event_type WHEN 'click' THEN 'ZGCAllocRate' WHEN 'view' THEN 'ZGCTimer' WHEN 'purchase' THEN 'ZGCSystemGc' WHEN 'signup' THEN 'ZGCWarmup' ELSE 'ZGCAllocStall' END AS category, count(*) AS n, count(*) AS pauses FROM events GROUP BY 1""")
def category_zgc(spark, sf_dir):
    return _category_counts(_events(spark, sf_dir, synth.unified_zgc, ()))


@query("""SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'PSFullGC' ELSE 'PSYoungGC' END AS category, round(value / 1000, 7) AS duration_s, 9000 + event_id % 1000 AS heap_before, 6000 + event_id % 500 AS heap_after, 2000 + event_id % 900 AS young_before,
CASE WHEN event_type IN ('purchase', 'error') THEN 5000 + event_id % 700 ELSE 7000 + event_id % 1000 - event_id % 900 END AS old_before, CASE WHEN event_type IN ('purchase', 'error') THEN 3000 + event_id % 50 END AS metaspace, event_id + (event_id % 1000) / 1000.0::DOUBLE AS uptime_s FROM events""")
def legacy_parallel_roundtrip(spark, sf_dir):
    rows = _events(spark, sf_dir, synth.legacy_parallel)
    return rows.select((F.col("pos") / 100).cast("bigint").alias("event_id"), "category", F.round("duration_s", 7).alias("duration_s"), F.col("heap.occ_before").alias("heap_before"), F.col("heap.occ_after").alias("heap_after"), F.col("young.occ_before").alias("young_before"), F.col("old.occ_before").alias("old_before"), F.col("metaspace.occ_after").alias("metaspace"), "uptime_s")


@query("""SELECT event_id, round(value / 1000, 7) AS duration_s, CASE event_type WHEN 'view' THEN 3000 + event_id % 700 WHEN 'purchase' THEN 3000 + event_id % 700 WHEN 'signup' THEN NULL ELSE 9000 + event_id % 1000 + CASE WHEN event_type = 'click' THEN 81000 ELSE 0 END END AS heap_before,
CASE event_type WHEN 'click' THEN 20000 + event_id % 1000 - event_id % 900 WHEN 'signup' THEN NULL ELSE 1000 + event_id % 500 END AS old_before, CASE WHEN event_type = 'purchase' AND event_id % 9 > 0 THEN round((event_id % 9) / 1000.0, 7)::DOUBLE END AS unloading FROM events""")
def legacy_cms_roundtrip(spark, sf_dir):
    rows = _events(spark, sf_dir, synth.legacy_cms)
    return rows.select((F.col("pos") / 100).cast("bigint").alias("event_id"), F.round("duration_s", 7).alias("duration_s"), F.col("heap.occ_before").alias("heap_before"), F.col("old.occ_before").alias("old_before"), F.when(F.col("cms.class_unload_s") > 0, F.round("cms.class_unload_s", 7)).alias("unloading"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'G1YoungGC' WHEN 'view' THEN 'G1Remark' WHEN 'purchase' THEN 'G1SystemGC' WHEN 'signup' THEN 'G1InitialMark' ELSE 'G1MixedGC' END AS category, round(value / 1000, 7) AS duration_s,
CASE WHEN event_type <> 'view' THEN event_id % 4000 END AS eden_before, CASE WHEN event_type <> 'view' THEN (1 + event_id % 200) * 1024 + 512 END AS heap_before, CASE WHEN event_type <> 'view' THEN event_id % 9000 END AS heap_after, CASE WHEN event_type <> 'view' THEN event_id % 66 END AS survivor_after FROM events""")
def legacy_g1_block_assembly(spark, sf_dir):
    rows = _events(spark, sf_dir, synth.legacy_g1)
    return rows.select((F.col("pos") / 100).cast("bigint").alias("event_id"), "category", F.round("duration_s", 7).alias("duration_s"), F.col("eden.occ_before").alias("eden_before"), F.col("heap.occ_before").alias("heap_before"), F.col("heap.occ_after").alias("heap_after"), F.col("survivor.occ_after").alias("survivor_after"))


@query("""SELECT event_id, CASE WHEN event_type <> 'signup' THEN event_id % 50 END AS eden_before, CASE WHEN event_type <> 'signup' THEN event_id % 41 END AS old_after, CASE WHEN event_type <> 'signup' THEN 1000 + event_id % 100 END AS metaspace_before, CAST(event_id AS BIGINT) AS gc_id FROM events""")
def multiline_segmentation(spark, sf_dir):
    rows = _events(spark, sf_dir, columns=("r_eden", "r_old", "metaspace"))
    return rows.select((F.col("pos") / 100).cast("bigint").alias("event_id"), F.col("r_eden.before").alias("eden_before"), F.col("r_old.after").alias("old_after"), F.col("metaspace.occ_before").alias("metaspace_before"), "gc_id")




def _mixed_lines(spark, sf_dir) -> DataFrame:
    """Each user's file in the dialect that user_id mod 6 picks; the sixth is of no known dialect."""
    events = synth.events_table(spark, sf_dir)
    out = None
    for k, make in enumerate((synth.unified_g1, synth.legacy_parallel, synth.legacy_cms, synth.legacy_g1, synth.unified_zgc)):
        own = make(events.where(F.col("user_id") % 6 == k))
        out = own if out is None else out.unionByName(own)
    other = events.where("user_id % 6 = 5").select(synth.path("other").alias("path"), F.lit(synth.HOST).alias("host"), F.lit(0).cast("bigint").alias("split"), (F.col("event_id") * 100).alias("pos"), F.concat(F.lit("request took "), F.col("value").cast("string"), F.lit(" ms")).alias("line"))
    return out.unionByName(other)


@query("""SELECT DISTINCT '/var/log/' || CASE user_id % 6 WHEN 0 THEN 'app' WHEN 1 THEN 'par' WHEN 2 THEN 'cms' WHEN 3 THEN 'g1' ELSE 'zgc' END || '-' || user_id || '/gc.log' AS path,
CASE user_id % 6 WHEN 0 THEN 'g1' WHEN 1 THEN 'parallel' WHEN 2 THEN 'cms' WHEN 3 THEN 'g1' ELSE 'zgc' END AS collector, user_id % 6 IN (0, 4) AS unified FROM events WHERE user_id % 6 < 5""")
def dialect_dispatch(spark, sf_dir):
    return diary(_mixed_lines(spark, sf_dir)).select("path", "collector", "unified")


@query("SELECT count(*) FILTER (user_id % 6 < 5) AS events, count(DISTINCT user_id) FILTER (user_id % 6 < 5) AS files FROM events")
def unregistered_lines_dropped(spark, sf_dir):
    folder = _shared(spark)
    _mixed_lines(spark, sf_dir).write.parquet(folder)  # they are read by the diary and by each branch
    lines = spark.read.parquet(folder)
    return parse_events(lines, diary(lines), columns=()).agg(F.count("*").alias("events"), F.count_distinct("path").alias("files"))


@query("""WITH l AS (SELECT user_id, 2 + sum(CASE WHEN event_type = 'signup' THEN 2 ELSE 7 END) AS n FROM events GROUP BY user_id)
SELECT '/var/log/app-' || user_id || '/gc.log' AS path, least(n, 512)::BIGINT AS n FROM l""")
def header_sample_512(spark, sf_dir):
    return head_lines(synth.unified_g1(synth.events_table(spark, sf_dir))).groupBy("path").agg(F.count("*").alias("n"))


def _files(spark, sf_dir) -> DataFrame:
    return synth.events_table(spark, sf_dir).groupBy(synth.path().alias("path")).agg(F.max("ts").alias("modified"), F.count("*").alias("length"))


_FILES_SQL = "SELECT '/var/log/app-' || user_id || '/gc.log' AS path, max(ts) AS modified, user_id FROM events GROUP BY user_id"


@query(f"WITH f AS ({_FILES_SQL}) SELECT path FROM f WHERE user_id % 7 <> 0 OR user_id % 14 = 0")
def quarantine_anti_join(spark, sf_dir):
    from ..sources.lines import admit

    files = _files(spark, sf_dir)
    now = files.agg(F.max("modified")).first()[0]
    hours = F.when(F.col("user_id") % 14 == 0, 3).otherwise(0)
    quarantine = synth.events_table(spark, sf_dir).where("user_id % 7 = 0").select(synth.path().alias("path"), (F.lit(now) - F.make_dt_interval(hours=hours)).alias("since")).distinct()
    return admit(files, now, idle_ms=10**12, quarantine=quarantine).select("path")


@query(f"WITH f AS ({_FILES_SQL}) SELECT path FROM f WHERE user_id % 3 <> 0")
def open_new_files(spark, sf_dir):
    from ..sources.lines import admit

    files = _files(spark, sf_dir)
    opened = files.where(F.regexp_extract("path", r"-(\d+)/", 1).cast("bigint") % 3 == 0)
    return admit(files, files.agg(F.max("modified")).first()[0], idle_ms=10**12, opened=opened).select("path")


@query(f"WITH f AS ({_FILES_SQL}) SELECT path, user_id FROM f WHERE modified >= (SELECT max(modified) FROM f) - INTERVAL 6 HOUR")
def idle_expiry(spark, sf_dir):
    events = synth.events_table(spark, sf_dir)
    state = _state(spark, sf_dir, {"event_last_minute_duration_seconds"})
    now = events.agg(F.max("ts")).first()[0]
    seen = events.select(synth.path().alias("path"), F.col("ts").alias("last_seen"))
    return A.expire(state, seen, F.lit(now), 6 * 3_600_000).select("path", _user())


@query(f"SELECT user_id, count(*) AS n, round({_SUM}, 6) AS total, arg_max(value, event_id) / 1000 AS last FROM events GROUP BY user_id")
def rotation_carry_over(spark, sf_dir):
    """Two generations of each file: the state of the first, merged with that of the second, counts on."""
    events = synth.events_table(spark, sf_dir)
    parts = []
    for half in (0, 1):
        lines = synth.unified_g1(events.where(F.col("event_id") < 5000 if half == 0 else F.col("event_id") >= 5000))
        parts.append(A.metric_state(observe(parse_events(lines, diary(lines), [(True, "g1")], ("duration_s",)), names={"event_last_minute_duration_seconds"})))
    return A.merge_state(*parts).select(_user(), "n", F.round("total", 6).alias("total"), "last")


@query("SELECT DISTINCT '/var/log/app-' || user_id || '/gc.log' AS path FROM events WHERE user_id % 2 = 0 OR user_id % 3 = 0")
def multi_glob_union(spark, sf_dir):
    files = _files(spark, sf_dir)
    user = F.regexp_extract("path", r"-(\d+)/", 1).cast("bigint")
    return files.where(user % 2 == 0).unionByName(files.where(user % 3 == 0)).dropDuplicates(["path"]).select("path")


@query("SELECT 'collect_files' AS name, '/var/log/app-' || user_id || '/gc.log' AS path, 1.0::DOUBLE AS value FROM (SELECT DISTINCT user_id FROM events)")
def info_gauge_files(spark, sf_dir):
    info = A.info_gauges(diary(synth.unified_g1(synth.events_table(spark, sf_dir))), 0.0, "1", synth.HOST)
    return info.where("name = 'collect_files'").select("name", F.col("labels.path").alias("path"), "value")


@query(f"""WITH s AS (SELECT 'gc_event_duration_seconds' AS f, 'category="' || {_G1_CATEGORY} || '",host="localhost",path="/var/log/app-' || user_id || '/gc.log"' AS l, count(*) AS n FROM events GROUP BY ALL)
SELECT f AS family, f || '_count{{' || l || '}} ' || n || '.0' AS line FROM s UNION ALL SELECT DISTINCT f, '# TYPE ' || f || ' summary' FROM s UNION ALL SELECT DISTINCT f, '# HELP ' || f || ' ' || replace(f, '_', ' ') FROM s""")
def family_merge_exposition(spark, sf_dir):
    samples = A.samples(_state(spark, sf_dir, {"event_duration_seconds"}))
    return exposition.render(samples, ["gc_event_duration_seconds_count"])


@query("SELECT 'gc_event_duration_seconds_sum' AS name, count(DISTINCT (user_id, event_type)) AS n FROM events UNION ALL SELECT 'gc_event_duration_seconds_count', count(DISTINCT (user_id, event_type)) FROM events")
def created_filter(spark, sf_dir):
    samples = A.samples(_state(spark, sf_dir, {"event_duration_seconds"}))
    created = F.when(F.col("name").endswith("_count"), F.replace("name", F.lit("_count"), F.lit("_created")))
    both = samples.withColumn("name", F.explode(F.array_compact(F.array("name", created))))
    return exposition.visible(both).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS lines, count(*) FILTER (event_id % 4 <> 0) AS events FROM events")
def line_error_isolation(spark, sf_dir):
    """Every fourth line is cut in the middle; it yields nothing and stops nothing."""
    lines = synth.legacy_parallel(synth.events_table(spark, sf_dir))
    lines = lines.withColumn("line", F.when((F.col("pos") >= 0) & (F.col("pos") / 100 % 4 == 0), F.substring("line", 1, 70)).otherwise(F.col("line")))
    events = parse_events(lines, diary(lines), [(False, "classic")])
    return lines.where("pos >= 0").agg(F.count("*").alias("lines")).join(events.agg(F.count("*").alias("events")))


@query("""WITH w AS (SELECT user_id, value / 1000 AS v, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, date_trunc('millisecond', ts)) + INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, date_trunc('millisecond', ts)) + INTERVAL 60 MINUTE, INTERVAL 10 MINUTE)) AS window_end FROM events)
SELECT user_id, epoch(window_end)::BIGINT AS window_end, count(*) AS n, quantile_disc(v, 0.0) AS q0, quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.75) AS q75, quantile_disc(v, 1.0) AS q100 FROM w GROUP BY ALL""")
def last_minute_quantiles_hop(spark, sf_dir):
    obs = _observed(spark, sf_dir, {"event_last_minute_duration_seconds"})
    return A.window_quantiles(obs, "60 minutes", "10 minutes").select(_user(), F.col("window_end").cast("bigint").alias("window_end"), "n", "q0", "q50", "q75", "q100")


@query("""SELECT event_id, count(*) OVER w AS n, quantile_disc(value / 1000, 0.5) OVER w AS q50, max(value / 1000) OVER w AS q100 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)""")
def last_minute_quantiles_range(spark, sf_dir):
    obs = _observed(spark, sf_dir, {"event_last_minute_duration_seconds"})
    return A.trailing_quantiles(obs, 86_400).select((F.col("pos") / 100).cast("bigint").alias("event_id"), "n", "q50", "q100")


# Beyond the surveyed operators: windows that Spark has at hand.


@query("""WITH g AS (SELECT user_id, date_trunc('millisecond', ts) AS ts, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER w < 1800000 THEN 0 ELSE 1 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def gc_storm_sessions(spark, sf_dir):
    obs = _observed(spark, sf_dir, {"event_last_minute_duration_seconds"})
    return obs.groupBy(_user(), F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast("bigint").alias("began"), "n")


@query(f"SELECT user_id, {_G1_CATEGORY} AS category, count(*) AS n, max(value / 1000) AS longest FROM events GROUP BY ROLLUP (user_id, category)")
def pause_rollup(spark, sf_dir):
    return _events(spark, sf_dir, columns=("duration_s",)).withColumn("user_id", _user()).rollup("user_id", "category").agg(F.count("*").alias("n"), F.max("duration_s").alias("longest"))


@query("SELECT event_id, value / 1000 AS duration_s FROM events WHERE event_type <> 'signup' ORDER BY value DESC, event_id LIMIT 20")
def worst_pauses(spark, sf_dir):
    rows = _events(spark, sf_dir, columns=("duration_s",)).where("is_pause").select((F.col("pos") / 100).cast("bigint").alias("event_id"), "duration_s")
    return rows.orderBy(F.desc("duration_s"), "event_id").limit(20)

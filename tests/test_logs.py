import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from heaplens.config import LogConfig, split_patterns
from heaplens.operators import aggregate as A
from heaplens.operators import exposition
from heaplens.operators.dialect import diary, head_lines
from heaplens.operators.events import dialects, parse_events
from heaplens.operators.observations import observe
from heaplens.plans.catalog import catalog, families
from heaplens.sources.lines import admit, list_files, match_names, read_lines

FIXTURES = pathlib.Path(__file__).parent / "fixtures"
KIB = 1024


@pytest.fixture(scope="module")
def lines(spark):
    return read_lines(spark, f"{FIXTURES}/*.log").cache()


@pytest.fixture(scope="module")
def events(lines):
    known = diary(lines)
    return parse_events(lines, known, dialects(known)).withColumn("file", F.regexp_extract("path", "([^/]*)$", 1)).cache()


def of(events, file):
    return events.where(F.col("file") == file).orderBy("split", "pos").collect()


def test_diary(lines):
    got = {pathlib.Path(r.path).name: (r.unified, r.collector, r.family, r.region_kib) for r in diary(lines).collect()}
    assert got == {
        "parallel.log": (False, "parallel", "classic", None), "cms.log": (False, "cms", "classic", None), "serial.log": (False, "serial", "classic", None), "g1-legacy.log": (False, "g1", "g1", None),
        "g1.log": (True, "g1", "g1", 1024), "zgc.log": (True, "zgc", "zgc", None),
    }


def test_parallel(events):
    rows = of(events, "parallel.log")
    assert [r.category for r in rows] == ["PSYoungGC", "PSFullGC", "PSFullGC"]
    young, full, _ = rows
    assert young.heap.asDict() == {"occ_before": 1500, "size_before": 9000, "occ_after": 900, "size_after": 9000}
    assert young.old.asDict() == {"occ_before": 500, "size_before": 6000, "occ_after": 700, "size_after": 6000}
    assert (full.old.occ_before, full.old.occ_after, full.metaspace.occ_after, full.duration_s, full.uptime_s) == (700, 650, 30, 0.02, 1.2)
    assert young.ts == datetime.datetime(2024, 3, 1, 10, 0, 0, 100000) and all(r.is_pause for r in rows)


def test_cms(events):
    rows = of(events, "cms.log")
    assert [r.category for r in rows] == ["ParNew", "ParNewPromotionFailed", "CMSInitialMark", "CMSConcurrentMark", "CMSConcurrentPreClean", "CMSAbortablePreClean", "CMSRemark", "CMSConcurrentSweep", "CMSConcurrentReset", "CMSConcurrentModeFailure"]
    assert [r.is_pause for r in rows] == [True, True, True, False, False, False, True, False, False, True]
    assert rows[0].refs.asDict() == {"soft_n": 3, "soft_s": 1e-05, "weak_n": 7, "weak_s": 2e-05, "final_n": 5, "final_s": 3e-05, "phantom_n": 2, "phantom_freed_n": 1, "phantom_s": 4e-05, "jni_n": None, "jni_s": 5e-05}
    assert rows[3].duration_s == 0.02  # wall time
    assert rows[6].cms.asDict() == {"class_unload_s": 0.0015, "symbol_s": 0.0005, "string_s": 0.0001, "symbol_string_s": None}
    assert (rows[9].old.occ_before, rows[9].heap.occ_after, rows[9].duration_s) == (1600, 500, 0.041)


def test_serial(events):
    assert [r.category for r in of(events, "serial.log")] == ["DefNew", "SystemGC", "FullGC"]


def test_legacy_g1(events):
    rows = of(events, "g1-legacy.log")
    assert [r.category for r in rows] == ["G1YoungGC", "G1MixedGC", "G1InitialMark", "G1Remark", "G1Cleanup", "G1SystemGC"]
    assert rows[0].eden.asDict() == {"occ_before": 24576, "size_before": 24576, "occ_after": 0, "size_after": 13312}
    assert (rows[0].survivor.occ_after, rows[0].heap.occ_after, rows[0].duration_s) == (3072, 8000, 0.005)
    assert (rows[5].heap.occ_after, rows[5].metaspace.occ_after) == (700, 4101) and rows[3].heap is None and rows[4].duration_s == 0.0009


def test_unified_g1(events):
    rows = of(events, "g1.log")
    assert [r.category for r in rows] == ["G1YoungGC", "G1InitialMark", "G1ConcurrentScanRootRegion", "G1ConcurrentMark", "G1Remark", "G1Cleanup", "G1MixedGC", "G1SystemGC"]
    first = rows[0]
    assert (first.r_eden.before, first.r_eden.assigned, first.r_old.assigned, first.r_humongous.after) == (20, 15, None, 1)
    assert (first.eden.occ_before, first.survivor.occ_after, first.heap.size_after, first.metaspace.occ_after) == (20 * KIB, 3 * KIB, 256 * KIB, 6100)
    assert rows[3].duration_s == 0.01025 and not rows[3].is_pause and rows[1].r_eden is None


def test_zgc(events):
    rows = of(events, "zgc.log")
    assert [r.category for r in rows] == ["ZGCWarmup", "ZGCAllocRate", "ZGCSystemGc", "ZGCMetadataGCThreshold"]
    first, last = rows[0], rows[3]
    assert first.duration_s == pytest.approx(0.045) and first.zgc.pause_mark_end_ms == 4.0 and last.zgc.conc_mark_free_ms == 0.0
    assert (first.zgc.load15, first.zgc.mmu[5], first.zgc.metaspace.reserved, first.zgc.relocate_end.used) == (3.75, 92.5, 14 * KIB, 60 * KIB)
    assert first.zgc.garbage.asDict() == {"mark_end": 40 * KIB, "reclaim_start": 30 * KIB, "reclaim_end": 5 * KIB} and first.zgc.memory.reclaim_end == 2 * KIB


def test_catalog(spark):
    rows = catalog(spark, "x_").collect()
    assert len(rows) == len({r.name for r in rows}) == 103
    kinds = [f.kind for f in families()]
    assert (kinds.count("gauge"), kinds.count("summary"), kinds.count("counter")) == (80, 22, 1)
    for name in ("weak_reference_pause_seconds", "g1_eden_heap_occupancy_before_collection_bytes", "zgc_garbage_reclaim_start_heap_bytes", "g1_survivor_size_bytes", "log_lines_total"):
        assert f"x_{name}" in {r.name for r in rows}


def last_values(events, strict=False):
    state = A.metric_state(observe(events, strict))
    return {(r.file, r.name, r.category): r for r in state.withColumn("file", F.regexp_extract("path", "([^/]*)$", 1)).collect()}


def test_metrics(events):
    got = last_values(events)
    full = got["parallel.log", "event_duration_seconds", "PSFullGC"]
    assert (full.n, full.total) == (2, 0.05)
    assert got["parallel.log", "heap_occupancy_after_collection_bytes", None].last == 600 * KIB
    assert got["parallel.log", "metaspace_occupancy_before_collection_bytes", None].last == 31 * KIB  # an event without metaspace leaves it
    assert got["cms.log", "soft_references", None].last == 3 and got["cms.log", "cms_class_unloading_process_duration_seconds", None].total == 0.0015
    assert ("cms.log", "cms_symbol_and_string_table_process_seconds", None) not in got and ("g1.log", "old_occupancy_after_collection_bytes", None) not in got
    assert ("cms.log", "event_pause_duration_seconds", "CMSConcurrentMark") not in got
    assert got["g1.log", "young_occupancy_before_collection_bytes", None].last == 0  # the last pause has no regions
    assert got["zgc.log", "event_pause_duration_seconds", "ZGCWarmup"].total == pytest.approx(0.013)
    assert got["zgc.log", "zgc_2ms_mmu_ratio", None].last == 0.9
    # at relocate end the snapshot of relocate start is shown, and live memory at mark end isn't scaled
    assert got["zgc.log", "zgc_relocate_end_used_bytes", None].last == 120 * KIB * KIB and got["zgc.log", "zgc_live_mark_end_bytes", None].last == 50 * KIB
    strict = last_values(events.where("family = 'zgc'"), True)
    assert strict["zgc.log", "zgc_relocate_end_used_bytes", None].last == 60 * KIB * KIB and strict["zgc.log", "zgc_live_mark_end_bytes", None].last == 50 * KIB * KIB


def test_merge_expire(spark, events):
    observed = observe(events.where("file = 'parallel.log'"))
    first, second = (A.metric_state(observed.where(t)) for t in ("ts < '2024-03-01 10:00:01'", "ts >= '2024-03-01 10:00:01'"))
    whole = A.metric_state(observed)
    assert sorted(map(str, A.merge_state(first, second).collect())) == sorted(map(str, whole.select(*A.merge_state(first, second).columns).collect()))
    now = datetime.datetime(2024, 1, 1, 12)
    seen = spark.createDataFrame([("a", now - datetime.timedelta(hours=2)), ("b", now)], "path string, last_seen timestamp")
    state = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    assert [r.path for r in A.expire(state, seen, F.lit(now)).collect()] == ["b"]


def test_page(lines, events):
    known = diary(lines)
    samples = A.samples(A.metric_state(observe(events.drop("file"))), lines, info=A.info_gauges(known, 12.0, "9", "here"))
    created = samples.where("name = 'gc_startup_timestamp_seconds'").withColumn("name", F.lit("gc_x_created"))
    text = exposition.page(samples.unionByName(created))
    assert 'gc_exporter_version_info{host="here",version="9"} 1.0' in text and "_created" not in text
    assert text.count("# TYPE gc_event_duration_seconds summary") == 1
    assert f'gc_log_lines_total{{host="localhost",path="{FIXTURES}/parallel.log"}} 8.0' in text
    only = exposition.page(samples, ["gc_log_lines_total"])
    assert {x.split("{")[0] for x in only.splitlines() if x[0] != "#"} == {"gc_log_lines_total"}
    assert exposition.page(samples.where("false")) == ""


def test_quantiles(events):
    observed = observe(events.where("file = 'parallel.log'"), names={"event_last_minute_duration_seconds"})
    row = A.window_quantiles(observed, "1 hour", "1 hour").first()
    assert (row.n, row.q0, row.q50, row.q75, row.q100) == (3, 0.01, 0.02, 0.03, 0.03)
    assert [r.n for r in A.trailing_quantiles(observed, 2).orderBy("pos").collect()] == [1, 2, 2]
    latest = A.latest_quantiles(observed, F.lit(datetime.datetime(2024, 3, 1, 10, 0, 30)))
    assert {r["quantile"]: r["value"] for r in latest.collect()} == {"0.0": 0.01, "0.5": 0.02, "0.75": 0.03, "1.0": 0.03}


def test_head_limits(spark, tmp_path):
    (tmp_path / "long.log").write_text("Using G1\n" + "x" * 2000 + "\n")
    (tmp_path / "late.log").write_text("\n" * 600 + "Using G1\n")
    (tmp_path / "crlf.log").write_bytes(b"[0.010s][info][gc] Using G1\r\n\r\n[1.0s][info][gc] GC(0) Pause Remark 1M->1M(2M) 1.000ms\r\n[2.0s][info][gc] GC(1) Pause Remark 1M->1M(2M) 2.000ms")
    lines = read_lines(spark, str(tmp_path / "*.log"))
    known = diary(lines)
    assert [pathlib.Path(r.path).name for r in known.collect()] == ["crlf.log"]
    assert head_lines(lines.where("path LIKE '%late%'")).count() == 0
    assert sorted(r.duration_s for r in parse_events(lines, known).collect()) == [0.001, 0.002]  # the last line has no end


def test_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"gc-{k}.log").write_text("x")
    (tmp_path / "other.txt").write_text("x")
    files = list_files(spark, [f"{tmp_path}/gc-*.log", f"{tmp_path}/*"])
    assert files.count() == 5
    assert match_names(files, str(tmp_path), r"gc-\d\.log").count() == 4
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    one = files.where("path LIKE '%gc-1%'")
    assert admit(files, now, opened=one).count() == 4
    assert admit(files, now + datetime.timedelta(hours=2)).count() == 0
    bad = one.select("path", F.lit(now).alias("since"))
    assert admit(files, now, quarantine=bad).count() == 4 and admit(files, now + datetime.timedelta(minutes=61), idle_ms=10**10, quarantine=bad).count() == 5


def test_config():
    config = LogConfig.from_mapping({"globs": "/a/{x,y}.log,/b/*.log", "unknown": 1, "port": 6000})
    assert config.globs == ["/a/{x,y}.log", "/b/*.log"] and config.watch_interval == 30_000
    assert split_patterns("") == []
    for bad in ({}, {"globs": "x", "port": 80}, {"globs": "x", "batch_size": 0}, {"globs": "x", "watch_interval": -1}):
        with pytest.raises(ValueError):
            LogConfig(**bad)


def test_views(spark):
    from heaplens.sql import register

    register(spark, f"{FIXTURES}/serial.log")
    assert spark.sql("SELECT count(*) FROM gc_events").first()[0] == 3
    assert spark.sql("SELECT value FROM gc_samples WHERE name = 'gc_log_lines_total'").first()[0] == 4

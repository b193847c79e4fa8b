"""Events of several lines: what is asked for decides which lines are shuffled."""

from heaplens.operators.dialect import diary
from heaplens.operators.events import parse_events
from heaplens.operators.observations import asked

LINES = [
    "[0.010s][info][gc] Using G1", "[0.011s][info][gc,heap] Heap region size: 2M", "[1.0s][info][gc] GC(7) Eden regions: 1->2(3)", "[1.0s][info][gc] GC(7) Eden regions: 4->5(6)", "[1.0s][info][gc] GC(7) Metaspace: 10K->11K(12K)",
    "[1.1s][info][gc] GC(7) Pause Remark 100M->10M(512M) 1.000ms", "[2.0s][info][gc] GC(7) Old regions: 8->9", "[2.1s][info][gc] GC(7) Pause Remark 90M->9M(512M) 2.000ms", "[3.0s][info][gc] GC(7) Eden regions: 7->7(7)",
]


def _lines(spark):
    return spark.createDataFrame([("/a", "h", 0, k, x) for k, x in enumerate(LINES)], "path string, host string, split bigint, pos bigint, line string")


def _windows(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Window")


def test_events_of_one_number_part_at_their_last_lines(spark):
    rows = parse_events(lines := _lines(spark), diary(lines)).orderBy("pos").collect()
    assert [(r.pos, r.heap.occ_before // 1024, r.duration_s) for r in rows] == [(5, 100, 0.001), (7, 90, 0.002)]
    assert rows[0].r_eden.before == 4 and rows[0].metaspace.occ_before == 10 and rows[0].r_old is None
    assert rows[1].r_eden is None and rows[1].metaspace is None and rows[1].r_old.after == 9  # what the first event's lines tell isn't told of the second


def test_lines_that_are_not_asked_for_are_not_shuffled(spark):
    lines = _lines(spark)
    known = diary(lines)
    few = parse_events(lines, known, [(True, "g1")], ("r_eden",)).orderBy("pos").collect()
    assert [r.r_eden and r.r_eden.before for r in few] == [4, None] and [r.metaspace for r in few] == [None, None]
    durations = parse_events(lines, known, [(True, "g1")], asked({"event_last_minute_duration_seconds"})).select("pos", "duration_s")
    assert _windows(durations) == 0 and sorted(r.duration_s for r in durations.collect()) == [0.001, 0.002]


def test_what_families_ask_for():
    assert {"zgc.mmu"} <= asked({"zgc_2ms_mmu_ratio"}) and not any(c in asked({"zgc_2ms_mmu_ratio"}) for c in ("zgc", "duration_s"))
    assert "eden" in asked({"g1_eden_size_after_collection_bytes"}) and "survivor" not in asked({"g1_eden_size_after_collection_bytes"})

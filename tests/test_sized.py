"""What is sorted, read and asked of a line, by the plans."""

import re

from heaplens.operators import aggregate as A
from heaplens.operators.dialect import _marked, _tests
from heaplens.plans import queries

DATA = "/root/testdata/sf0.001"


def test_last_values_need_no_sort_of_observations(spark):
    """Observations are combined by hash, within splits; a later split wins over a later place of an earlier one, and a null value counts as the last."""
    rows = [("x", "p", "h", "c", 1.0, 0, 900), ("x", "p", "h", "c", 2.0, 5, 3), ("x", "p", "h", "c", 4.0, 5, 2), ("x", "q", "h", None, 1.5, 0, 1), ("x", "q", "h", None, None, 0, 2)]
    obs = spark.createDataFrame(rows, "name string, path string, host string, category string, value double, split bigint, pos bigint").repartition(3)
    state = A.metric_state(obs)
    assert {tuple(r) for r in state.collect()} == {("x", "p", "h", "c", 3, 7.0, 2.0, 5, 3), ("x", "q", "h", None, 1, 1.5, None, 0, 2)}
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "max_by(value" in plan and not re.search(r"SortAggregate.*max_by\(value", plan)


def test_lines_of_all_dialects_are_made_once(spark):
    """The diary and each branch read lines that are there; none makes them anew."""
    rows = queries.QUERIES["unregistered_lines_dropped"](spark, DATA)
    assert "posexplode" not in rows._jdf.queryExecution().optimizedPlan().toString()
    events = spark.read.parquet(f"{DATA}/events.parquet").where("user_id % 6 < 5")
    assert tuple(rows.first()) == (events.count(), events.select("user_id").distinct().count())


def test_a_line_is_asked_once_for_marks(spark):
    lines = spark.createDataFrame([("Using G1",)], "line string").repartition(1)
    rows = _marked(lines).select(*[x.alias(k) for k, x in _tests().items()])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Contains(line") == 8 and rows.first().g1


def test_a_message_meets_its_pattern_once(spark):
    """What a pattern gives is a column of its own, and generators take columns that are there."""
    from heaplens.operators.events import zgc
    from heaplens.operators.observations import observe

    lines = spark.createDataFrame([("f", "h", 0, 1, "[0.1s][info][gc] GC(1) Pause Mark Start 1.000ms", "zgc", "zgc", None)], "path string, host string, split bigint, pos bigint, line string, family string, collector string, region_kib bigint")
    events = zgc(lines, {"zgc.pause_mark_start_ms", "duration_s"})
    assert events._jdf.queryExecution().optimizedPlan().toString().count("(Pause Mark Start|") == 1
    plan = observe(events, names={"zgc_pause_mark_start_duration_seconds", "event_duration_seconds"})._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(filter\(pairs#", plan)


def test_a_legacy_line_meets_its_patterns_once(spark):
    from heaplens.operators.events import legacy_classic

    line = "1.000: [GC (Allocation Failure) [PSYoungGen: 5K->4K(9K)] 12K->6K(99K), 0.1000000 secs]"
    lines = spark.createDataFrame([("f", "h", 0, 1, line, "classic", "parallel", None), ("f", "h", 0, 2, "no, 0.1 secs]", "classic", "parallel", None)], "path string, host string, split bigint, pos bigint, line string, family string, collector string, region_kib bigint")
    events = legacy_classic(lines)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PSYoungGen|ParNew") == 1 and plan.count("(?:Metaspace|Perm ?)") == 1
    assert [(r.heap.occ_after, r.young.occ_after, r.duration_s) for r in events.collect()] == [(6, 4, 0.1)]

from pyspark.sql import functions as F

from heaplens.operators.dialect import diary, head_lines
from heaplens.operators.events import parse_events

SCHEMA = "path string, host string, split bigint, pos bigint, line string"


def _file(path, lines, step=1, first=0):
    return [(path, "h", 0, first + k * step, x) for k, x in enumerate(lines)]


def test_places_of_signals(spark):
    """Places may be sparse; a signal counts up to line 512 exactly, wherever other lines of long files are."""
    fill = ["[1.000s][info][gc] nothing"]
    files = {
        "in": _file("in", fill * 511 + ["[1.000s][info][gc] Using G1"] + fill * 90, 100), "out": _file("out", fill * 512 + ["[1.000s][info][gc] Using G1"] + fill * 90, 100),
        "short": _file("short", fill * 300 + ["[1.000s][info][gc] Using G1"], 10**6), "first": _file("first", ["[0.1s][info][gc] Using The Z Garbage Collector"] + fill * 600 + ["Using G1"], 1000),
        "long": _file("long", ["[0.1s] Using G1"] + fill * 600 + ["x" * 2000]), "too long": _file("too long", ["[0.1s] Using G1"] + fill * 500 + ["x" * 2000] + fill * 90, 7), "blank": _file("blank", ["[0.1s] Using G1", " " * 2000]),
        "region": _file("region", ["[0.1s] Using G1", "[0.1s] Heap region size: 2M"] + fill * 600 + ["Heap region size: 4M"], 3),
        "late": _file("late", ["[0.1s] Using Concurrent Mark Sweep"] + fill * 600 + ["[ParNew: ", "-XX:+UseG1GC"]),
    }
    lines = spark.createDataFrame([row for rows in files.values() for row in rows], SCHEMA).withColumn("pos", F.col("pos") - 1000)
    got = {r.path: (r.unified, r.collector, r.region_kib) for r in diary(lines).collect()}
    assert got == {"in": (True, "g1", None), "short": (True, "g1", None), "first": (True, "zgc", None), "long": (True, "g1", None), "blank": (True, "g1", None), "region": (True, "g1", 2048), "late": (True, "cms", None)}
    assert head_lines(lines).where("path = 'out'").count() == 512


def test_lines_are_not_sorted_for_the_diary(spark):
    lines = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("path"), F.lit("h").alias("host"), F.lit(0).cast("bigint").alias("split"), F.col("id").alias("pos"), F.lit("[0.1s] Using G1").alias("line"))
    known = diary(lines)
    assert known.count() == 50
    assert "Window" not in known._jdf.queryExecution().toString()


def test_a_diary_of_many_files_goes_to_the_tasks(spark):
    """Beyond 10,000 files too, lines aren't shuffled and sorted by file."""
    lines = spark.range(24_000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 2)).alias("path"), F.lit("h").alias("host"), F.lit(0).cast("bigint").alias("split"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "[0.1s] Using G1").otherwise("[0.2s][info][gc] GC(1) Pause Remark 3M->2M(9M) 1.000ms").alias("line"))
    events = parse_events(lines, diary(lines), [(True, "g1")])
    assert events.count() == 12_000
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_legacy_blocks_move_no_lines(spark):
    """What a line of a legacy G1 block tells is read before anything is shuffled."""
    from heaplens.operators.events import legacy_g1

    lines = spark.createDataFrame([("f", "h", 0, 1, "1.000: [GC pause (young), 0.1 secs]", "g1", "g1", 1024)], SCHEMA + ", family string, collector string, region_kib bigint")
    events = legacy_g1(lines)
    plan = events._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [k for k, x in enumerate(plan) if "Window [count(head" in x]
    assert windows and all("line#" not in plan[k + 1] for k in windows)


def test_views_list_files_once(spark, tmp_path, monkeypatch):
    from heaplens import sql
    from heaplens.sources import lines

    (tmp_path / "gc.log").write_text("[0.1s][info][gc] Using G1\n[0.2s][info][gc] GC(1) Pause Remark 3M->2M(9M) 1.000ms\n")
    calls = []
    listed = lines._listed
    monkeypatch.setattr(lines, "_listed", lambda *x: calls.append(x) or listed(*x))
    sql.register(spark, f"{tmp_path}/*.log")
    assert len(calls) == 1 and spark.table("gc_events").count() == 1
    # the view of the diary is told: its file may go
    (tmp_path / "gc.log").unlink()
    assert [r.collector for r in spark.table("gc_diary").collect()] == ["g1"]


def test_lines_of_short_files_are_not_sorted_for_heads(spark):
    lines = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 50).alias("path"), F.lit("h").alias("host"), F.lit(0).cast("bigint").alias("split"), F.col("id").alias("pos"), F.lit("x").alias("line"))
    assert head_lines(lines).count() == 5000
    assert "Window" not in head_lines(lines)._jdf.queryExecution().toString()
    for count in (20, 10):  # files of 100 lines: dealt by file, or cut in tasks first
        got = head_lines(lines, count).groupBy("path").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()
        assert all(r.n == count and r.last == int(r.path[1:]) + 50 * (count - 1) for r in got) and len(got) == 50

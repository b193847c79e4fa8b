import os
import pathlib
import time

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heaplens.operators.dialect import diary
from heaplens.operators.events import parse_events
from heaplens.operators.observations import observe
from heaplens.sources.lines import read_lines
from heaplens.sources.tail import TailReader, TailSource
from heaplens.operators.aggregate import merge_rings, ring_quantiles, ring_sketches
from heaplens.operators.dialect import tell
from heaplens.streaming.changes import ChangeLog
from heaplens.streaming.files import waiting
from heaplens.streaming.job import MetricJob, stream_quantiles

FIXTURES = pathlib.Path(__file__).parent / "fixtures"


def pull(reader, start):
    end = reader.latestOffset()
    lines = [x for part in reader.partitions(start, end) for batch in reader.read(part) for x in batch.column(4).to_pylist()]
    return end, lines


def test_reader(tmp_path):
    log = tmp_path / "gc.log"
    log.write_text("".join(f"line:{i}\n" for i in range(100)))
    reader = TailReader({"globs": f"{tmp_path}/*.log", "startingOffsets": "earliest", "partitionBytes": "100"})
    end, lines = pull(reader, reader.initialOffset())
    assert lines == [f"line:{i}" for i in range(100)]
    with log.open("a") as f:
        f.write("whole\r\npart")
    end, lines = pull(reader, end)
    assert lines == ["whole"]
    with log.open("a") as f:
        f.write("ial\n")
    (tmp_path / "new.log").write_text("n\n")
    end, lines = pull(reader, end)
    assert lines == ["partial", "n"]
    log.write_text("short\n")  # truncated
    end, lines = pull(reader, end)
    assert lines == ["short"]
    os.rename(log, tmp_path / "gc.old")
    log.write_text("rotated, and longer than before\n")
    end, lines = pull(reader, end)
    assert lines == ["rotated, and longer than before"]
    assert pull(reader, end)[1] == []


def test_reader_limit_latest_idle_regex(tmp_path):
    log = tmp_path / "gc-1.log"
    log.write_text("a\nb\nc\n")
    now = [time.time()]
    reader = TailReader({"regexes": f"{tmp_path}/gc-\\d\\.log", "startingOffsets": "earliest", "linesPerSecond": "1"}, clock=lambda: now[0])
    start, seen = reader.initialOffset(), []
    for _ in range(4):
        start, lines = pull(reader, start)
        seen.append(lines)
        now[0] += 1
    assert seen == [["a"], ["b"], ["c"], []]
    latest = TailReader({"globs": str(log)})
    start = latest.initialOffset()
    assert pull(latest, start)[1] == []
    old = tmp_path / "gc-2.log"
    old.write_text("x\n")
    os.utime(old, (time.time() - 9999, time.time() - 9999))
    idle = TailReader({"globs": f"{tmp_path}/gc-2.log", "idleTimeout": "1000"})
    assert idle.advance(idle.empty())["files"] == {}
    assert TailReader({"globs": f"{tmp_path}/none/*.log", "regexes": f"{tmp_path}/none/x"}).files() == []


def test_reader_parts(tmp_path):
    """Parts are cut by bytes, anywhere: each line is read once and whole, long ones too, and a file that rotates after planning is found again."""
    log = tmp_path / "gc.log"
    lines = [f"{k}:" + "x" * (k * 37 % 500) for k in range(60)] + ["y" * 5000, "", "", "end"]
    log.write_text("".join(f"{x}\n" for x in lines) + "open")
    for size in ("1", "7", "64", "100000"):
        reader = TailReader({"globs": str(log), "startingOffsets": "earliest", "partitionBytes": size, "batchLines": "3", "maxBytesPerTrigger": "1000"})
        start, seen = reader.initialOffset(), []
        for _ in range(40):
            end = reader.latestOffset()
            parts = reader.partitions(start, end)
            assert len(parts) <= 6000 // int(size) + 1
            seen += [x for part in parts for batch in reader.read(part) for x in batch.column(4).to_pylist()]
            start = end
        assert seen == lines
    start, end = reader.encoded(reader.empty()), reader.encoded(reader.empty() | {"files": {str(log): [log.stat().st_ino, log.stat().st_size, 0, 0]}})
    parts = reader.partitions(start, end)
    os.rename(log, tmp_path / "gc.log.1")
    log.write_text("another file\n")
    assert [x for part in parts for batch in reader.read(part) for x in batch.column(4).to_pylist()] == lines


def test_reader_quarantine_watch(tmp_path):
    log = tmp_path / "gc.log"
    log.write_text("a\n")
    reader = TailReader({"globs": f"{tmp_path}/*.log", "watchInterval": "60000"})
    assert reader.files() == [str(log)]
    (tmp_path / "new.log").write_text("b\n")
    assert reader.files() == [str(log)]  # listed anew after the interval only
    reader.quarantine[str(log)] = time.time()
    again = TailReader({"globs": f"{tmp_path}/*.log"})
    again.partitions(reader.encoded(reader.empty()), reader.encoded(reader.empty() | {"quarantine": reader.quarantine}))  # what a restart reads back
    assert again.files() == [str(tmp_path / "new.log")]


def test_idle_files_leave_and_come_back(tmp_path):
    """Offsets shrink when files are idle; a file that grows again goes on where it was, also after a restart, and old positions age out."""
    now = [time.time()]
    options = {"globs": f"{tmp_path}/*.log", "startingOffsets": "earliest", "idleTimeout": "60000", "positionMemory": "1000000", "maxPositions": "3"}
    reader = TailReader(options, clock=lambda: now[0])
    for k in range(5):
        (tmp_path / f"{k}.log").write_text(f"first {k}\n")
    end, lines = pull(reader, reader.initialOffset())
    assert len(lines) == 5
    now[0] += 100  # all idle but one
    os.utime(tmp_path / "0.log", (now[0], now[0]))
    end, lines = pull(reader, end)
    state = reader.decoded(end)
    assert lines == [] and list(state["files"]) == [f"{tmp_path}/0.log"] and list(state["left"]) == [f"{tmp_path}/{k}.log" for k in (1, 2, 3)]  # of equal age the first stay
    with (tmp_path / "2.log").open("a") as f:
        f.write("second\n")
    os.utime(tmp_path / "2.log", (now[0], now[0]))
    again = TailReader(options, clock=lambda: now[0])
    assert pull(again, end)[1] == ["second"]
    end, lines = pull(reader, end)
    assert lines == ["second"] and set(reader.decoded(end)["files"]) == {f"{tmp_path}/0.log", f"{tmp_path}/2.log"}
    now[0] += 2_000_000  # beyond the memory of positions
    end, lines = pull(reader, end)
    state = reader.decoded(end)
    assert lines == [] and state["files"] == {} and set(state["left"]) == {f"{tmp_path}/0.log", f"{tmp_path}/2.log"}
    now[0] += 2_000_000
    end, _ = pull(reader, end)
    assert reader.decoded(end)["left"] == {}


def test_deleted_and_unread_files(tmp_path):
    """A file that vanishes for a while goes on where it was; one with lines yet to be read doesn't leave as idle."""
    now = [time.time()]
    log = tmp_path / "gc.log"
    log.write_text("a\nb\nc\n")
    reader = TailReader({"globs": f"{tmp_path}/*.log", "startingOffsets": "earliest", "idleTimeout": "1000", "linesPerSecond": "1"}, clock=lambda: now[0])
    end, lines = pull(reader, reader.initialOffset())
    assert lines == ["a"]
    now[0] += 5
    end, lines = pull(reader, end)
    assert lines == ["b"]
    os.rename(log, tmp_path / "away")
    end, lines = pull(reader, end)
    assert lines == [] and list(reader.decoded(end)["left"]) == [str(log)]
    os.rename(tmp_path / "away", log)
    os.utime(log, (now[0], now[0]))
    now[0] += 1
    assert pull(reader, end)[1] == ["c"]


def test_renamed_and_new_at_end(tmp_path):
    log = tmp_path / "gc.log"
    log.write_text("a\n")
    reader = TailReader({"globs": f"{tmp_path}/gc.log*", "startingOffsets": "earliest"})
    end, lines = pull(reader, reader.initialOffset())
    os.rename(log, tmp_path / "gc.log.1")  # also matched: what was read isn't read again
    with (tmp_path / "gc.log.1").open("a") as f:
        f.write("late\n")
    log.write_text("b\n")
    end, lines = pull(reader, end)
    assert sorted(lines) == ["b", "late"]
    at_end = TailReader({"globs": f"{tmp_path}/*", "newFileOffsets": "latest"})
    end, _ = pull(at_end, at_end.initialOffset())
    new = tmp_path / "new.log"
    new.write_text("before it was found\n")
    end, lines = pull(at_end, end)
    assert lines == []
    with new.open("a") as f:
        f.write("after\n")
    assert pull(at_end, end)[1] == ["after"]


def test_restart_keeps_generations(tmp_path):
    """A reader made anew goes on from the committed offset, with files that came while it was away from their beginning and generations where they were."""
    log = tmp_path / "gc.log"
    log.write_text("a\n")
    options = {"globs": f"{tmp_path}/*.log"}
    reader = TailReader(options)
    end, _ = pull(reader, reader.initialOffset())
    log.write_text("")
    end, _ = pull(reader, end)
    log.write_text("b\n")
    end, lines = pull(reader, end)
    assert lines == ["b"] and reader.decoded(end)["files"][str(log)][2] == 1
    with log.open("a") as f:
        f.write("c\n")
    (tmp_path / "new.log").write_text("d\n")
    again = TailReader(options)
    end, lines = pull(again, end)
    assert lines == ["c", "d"] and again.state["files"][str(log)][2] == 1
    with log.open("a") as f:
        f.write("e\n")
    after, lines = pull(again, end)
    assert lines == ["e"] and again.decoded(after)["files"][str(log)][2] == 1


def test_line_rate(tmp_path):
    """Tokens carry over triggers of any distance up to a second's worth, the rate holds in the long run, and nothing is lost."""
    now = [time.time()]
    log = tmp_path / "gc.log"
    lines = [f"line {k} " + "x" * (k * 13 % 90) for k in range(5000)]
    log.write_text("".join(f"{x}\n" for x in lines))
    for rate, steps in ((10, [0.05, 0.35, 0.6, 1.0]), (400, [0.25, 0.5, 0.9])):
        reader = TailReader({"globs": str(log), "startingOffsets": "earliest", "linesPerSecond": str(rate)}, clock=lambda: now[0])
        began, end, seen, step = now[0], reader.initialOffset(), [], 0
        while len(seen) < min(len(lines), 40 * rate):
            step += 1
            end, got = pull(reader, end)
            seen += got
            assert len(seen) <= rate * (1 + now[0] - began) * 1.1 + 1
            now[0] += steps[step % len(steps)]
            assert now[0] - began < 500
        assert seen == lines[: len(seen)] and now[0] - began <= 1.1 * len(seen) / rate + 2
        assert all(t <= rate for t in reader.decoded(end)["tokens"].values())
    # a reader made anew has the tokens of the offset, not a full bucket
    reader = TailReader({"globs": str(log), "startingOffsets": "earliest", "linesPerSecond": "5"}, clock=lambda: now[0])
    end, got = pull(reader, reader.initialOffset())
    assert len(got) == 5
    end, got = pull(reader, end)
    assert got == []
    now[0] += 0.5
    assert len(pull(reader, end)[1]) == 2


def test_scan_rate(tmp_path):
    """A listing goes on over as many triggers as its rate asks for, without sleeping; files found late start as those found at once."""
    now = [time.time()]
    for k in range(10):
        (tmp_path / f"{k}.log").write_text("old\n")
    reader = TailReader({"globs": f"{tmp_path}/*.log", "scanFilesPerSecond": "3"}, clock=lambda: now[0])
    began, end, counts = time.time(), reader.initialOffset(), []
    for _ in range(6):
        end, lines = pull(reader, end)
        assert lines == []
        counts.append(len(reader.decoded(end)["files"]))
        now[0] += 1
    assert counts == [3, 6, 9, 10, 10, 10] and time.time() - began < 2
    (tmp_path / "99.log").write_text("new\n")
    seen = []
    for _ in range(8):
        end, lines = pull(reader, end)
        seen += lines
        now[0] += 1
    assert seen == ["new"]


def test_quarantine_is_bounded(tmp_path):
    now = [1_000_000.0]
    reader = TailReader({"globs": f"{tmp_path}/*.log", "maxQuarantined": "3", "quarantineTimeout": "10000"}, clock=lambda: now[0])
    for k in range(5):
        (tmp_path / f"{k}.log").write_text("x\n")
        reader.quarantine[f"{tmp_path}/{k}.log"] = now[0] - k
    assert [os.path.basename(p) for p in reader.files()] == ["3.log", "4.log"] and len(reader.quarantine) == 3
    now[0] += 9
    assert [os.path.basename(p) for p in reader.files()] == ["2.log", "3.log", "4.log"]


def test_waiting_lines():
    """Lines of an event wait for its last line; those of a legacy G1 log wait from the last head on; other lines don't wait."""
    lines = ["[0.1s][info][gc] Using G1", "[1.0s][info][gc] GC(0) Eden regions: 2->0(1)", "[1.1s][info][gc] GC(0) Pause Remark 1M->1M(2M) 1.000ms", "[1.2s][info][gc] GC(0) after", "[2.0s][info][gc] GC(1) Eden regions: 3->0(1)"]
    assert waiting(lines, True, "g1") == [False, False, False, True, True] == waiting(lines, True, "classic")
    assert waiting(["[1s] GC(3) Load: 1/2/3", "[2s] GC(3) Garbage Collection (Timer) 10M(1%)->5M(1%)", "[3s] GC(4) Load: 1/2/3"], True, "zgc") == [False, False, True]
    legacy = (FIXTURES / "g1-legacy.log").read_text().splitlines()
    waits = waiting(legacy, False, "g1")
    assert waits == sorted(waits) and waits[-1] and not waits[0]
    assert waiting(["no head at all"], False, "g1") == [True] and waiting(["a", "b"], False, "classic") == [False, False] and waiting([], True, "g1") == []


def test_tell_agrees_with_the_diary(spark):
    known = {r.path.rsplit("/", 1)[1]: (r.unified, r.collector, r.family, r.region_kib) for r in diary(read_lines(spark, f"{FIXTURES}/*.log")).collect()}
    own = {p.name: tell(p.read_text().splitlines()[:512]) for p in FIXTURES.glob("*.log")}
    assert known == {name: told for name, told in own.items() if told} and len(known) > 5
    assert tell([]) is None and tell(["", "  "]) is None and tell(["Using G1", "x" * 1025]) is None and tell(["nothing"]) is None


def rows_written(folder, epoch):
    return sum(pq.read_metadata(p).num_rows for p in pathlib.Path(folder, f"changes={epoch}").glob("*.parquet"))


def test_change_log(spark, tmp_path):
    """An epoch writes the rows that it changes; one that is run again gives the same; snapshots let old folders go."""
    log = ChangeLog(spark, f"file://{tmp_path}/t", ["k"], "k string, v bigint", every=3)
    rows = lambda *kv: spark.createDataFrame(list(kv), "k string, v bigint")
    now = lambda e: {r.k: r.v for r in log.as_of(e).collect()}
    assert now(5) == {}
    log.write(rows(*[(f"k{i}", i) for i in range(50)], (None, -1)), None, 0)
    for _ in range(2):
        assert {r.k: r.v for r in log.write(rows(("k1", 100)), rows(("k2", 0)), 1).collect()} == {f"k{i}": 100 if i == 1 else i for i in range(50) if i != 2} | {None: -1}
    assert rows_written(f"{tmp_path}/t", 1) == 2 and len(now(0)) == 51
    log.write(rows(("k2", 7)), None, 2)
    want = now(2)
    assert want["k2"] == 7
    for e in (3, 4, 5, 5, 6):
        log.write(rows(("new", e)), None, e)
    assert now(6) == want | {"new": 6} and now(5) == want | {"new": 5} and now(4) == want | {"new": 4}
    assert log.folders() == [("changes", e) for e in (3, 4, 5, 6)] + [("snapshot", 2), ("snapshot", 5)]


def test_ring_of_sketches(spark):
    """Quantiles from the ring are within 0.05 of the rank asked for, however many values come and in how many batches; a sketch doesn't grow with them."""
    rng = np.random.default_rng(3)
    values = rng.exponential(size=60_000)
    obs = spark.createDataFrame(pd.DataFrame({"name": "m", "path": "p", "host": "h", "value": values, "at": np.arange(60_000) // 1000}))
    ts = F.timestamp_seconds(F.lit(1_000_000_000).cast("bigint") + F.col("at"))
    ring = ring_sketches(obs, ts)
    parts = [ring_sketches(obs.where(F.col("at") % 7 == k), ts) for k in range(7)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merge_rings(merged, part)
    for sketches in (ring, merged):
        got = {r.quantile: r.value for r in ring_quantiles(sketches, F.timestamp_seconds(F.lit(1_000_000_059))).collect()}
        assert got["0.0"] == values.min() and got["1.0"] == values.max()
        assert all(abs((values <= got[str(q)]).mean() - q) <= 0.05 for q in (0.5, 0.75))
        late = {r.quantile: r.value for r in ring_quantiles(sketches, F.timestamp_seconds(F.lit(1_000_000_080))).collect()}
        assert late["1.0"] == values[-30_000:].max()  # what is older than a minute has left in steps of ten seconds
    assert ring.agg(F.max(F.octet_length("sketch"))).first()[0] < 8192 and ring_quantiles(ring, F.timestamp_seconds(F.lit(1_000_000_500))).count() == 0


def test_job(spark, tmp_path):
    logs, pages = tmp_path / "logs", {}
    logs.mkdir()
    text = (FIXTURES / "g1.log").read_text().splitlines(keepends=True)
    (logs / "gc.log").write_text("".join(text[:5]))  # ends within an event
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("gclog_tail").option("globs", f"{logs}/*.log").option("startingOffsets", "earliest").load()
    job = MetricJob(spark, f"file://{tmp_path}/state", publish=lambda epoch, samples: pages.update({epoch: {(r["name"], r["labels"].get("category")): r["value"] for r in samples.collect()}}))
    for piece in (None, "".join(text[5:12]), "".join(text[12:])):
        if piece:
            with (logs / "gc.log").open("a") as f:
                f.write(piece)
        query = job.start(stream, f"file://{tmp_path}/checkpoint", availableNow=True)
        assert query.awaitTermination(120)
        if query.exception():
            raise query.exception()
    last = pages[max(pages)]
    assert last["gc_log_lines_total", None] == len(text)
    assert last["gc_event_duration_seconds_count", "G1YoungGC"] == 1 and last["gc_event_duration_seconds_sum", "G1YoungGC"] == pytest.approx(0.0045)
    assert last["gc_g1_eden_before_collection_regions", None] == 20  # its line came a batch before its event's end
    assert last["gc_heap_occupancy_after_collection_bytes", None] == 2**20


def test_job_forgets_idle_files(spark, tmp_path):
    """All series of an idle file go when its timer runs out; its dialect is known when it grows again. A batch writes the series that it touches and no others, and files are dealt to several tasks."""
    text = (FIXTURES / "serial.log").read_text().splitlines()
    schema = "path string, host string, split long, pos long, line string"

    def feeder(name, **options):
        pages, folder = {}, tmp_path / name
        (folder / "in").mkdir(parents=True)
        job = MetricJob(spark, f"file://{folder}/state", host="h", publish=lambda epoch, s: pages.update({epoch: {(r["name"], r["labels"].get("path")): r["value"] for r in s.collect()}}), **options)
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")

        def feed(*parts):
            rows = [(path, "h", 0, k, x) for path, part in parts for k, x in enumerate(part)]
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
            query = job.start(stream, f"file://{folder}/checkpoint", availableNow=True)
            assert query.awaitTermination(120)
            if query.exception():
                raise query.exception()
            return pages[max(pages)]

        return job, folder, feed

    job, folder, feed = feeder("steady")
    page = feed(*[(p, text) for p in "abcdef"])
    assert {p for _, p in page} == {*"abcdef", None} and ("gc_event_last_minute_duration_seconds", "a") in page
    first = rows_written(folder / "state" / "series", job.last_epoch)
    assert len([p for p in pathlib.Path(folder, "checkpoint", "state", "0").iterdir() if p.name.isdigit()]) >= 4  # a store for each task
    page = feed(("b", text[1:]))
    assert 0 < rows_written(folder / "state" / "series", job.last_epoch) <= first / 6 and page["gc_log_lines_total", "b"] == 2 * len(text) - 1
    assert {p for _, p in page} == {*"abcdef", None} and len(list((folder / "state" / "batches").iterdir())) == 2
    # here each batch finds the files of the batch before idle
    job, folder, feed = feeder("hasty", idle_ms=1, memory=10**9)
    feed(*[(p, text) for p in "abc"])
    page = feed(("b", text[1:]))
    assert {p for _, p in page} == {"b", None} and page["gc_log_lines_total", "b"] == len(text) - 1  # b was idle as well, and begins anew
    page = feed(("a", text[1:2]))
    assert {p for _, p in page} == {"a", None} and page["gc_log_lines_total", "a"] == 1
    assert {r.path: r.n for r in job.state().where("name = 'event_last_minute_duration_seconds'").collect()} == {"a": 1}


def test_stream_quantiles(spark, tmp_path):
    lines = read_lines(spark, f"{FIXTURES}/parallel.log")
    observed = observe(parse_events(lines, diary(lines)), names={"event_last_minute_duration_seconds"})
    late = observed.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    observed.unionByName(late).write.parquet(f"{tmp_path}/obs")
    stream = spark.readStream.schema(observed.schema).parquet(f"{tmp_path}/obs")
    query = stream_quantiles(stream, "1 hour", "1 hour").writeStream.format("memory").queryName("quantiles").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    assert query.awaitTermination(120)
    rows = spark.table("quantiles").where("n = 3").collect()
    assert len(rows) == 1 and rows[0].q[-1] == 0.03

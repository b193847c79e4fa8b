"""Dialects and families that a user adds, what becomes of lines, files whose errors are told, and the two formats of the page."""

import datetime
import gzip
import pathlib
import urllib.request

import pytest
from pyspark.sql import functions as F

from heaplens import registry
from heaplens.operators import aggregate as A
from heaplens.operators.dialect import diary, tell
from heaplens.operators.events import parse_events
from heaplens.operators.observations import observe
from heaplens.operators.rejects import outcomes, parse_with_rejects
from heaplens.plans.catalog import Family, families
from heaplens.sources.lines import admit, list_files, probe_files, quarantined, read_heads, read_lines
from heaplens.streaming.job import MetricJob
from heaplens.streaming.serve import Scrape, weights

FIXTURES = pathlib.Path(__file__).parent / "fixtures"
TOY = ["TOY 1.0", "tick 5ms 10K->4K small", "mark 7ms 9K->9K background", "noise", "", "tick 6ms 12K->3K big"]


def parse_toy(lines):
    part = lambda k: F.regexp_extract("line", r"^(?:tick|mark) (\d+)ms (\d+)K->(\d+)K (\w+)$", k)
    pool = F.struct(*[F.expr(f"try_cast({'p2' if k == 'occ_before' else 'p3'} AS bigint)").alias(k) if "occ" in k else F.lit(None).cast("bigint").alias(k) for k in ("occ_before", "size_before", "occ_after", "size_after")])
    rows = lines.withColumns({f"p{k}": part(k) for k in (1, 2, 3, 4)}).where("p1 <> ''")
    return rows.select("path", "host", "split", "pos", "family", "collector", F.col("p4").alias("label"), (F.col("p1").cast("double") / 1000).alias("duration_s"), pool.alias("heap"))


@pytest.fixture
def toy():
    registry.add_dialect(registry.Dialect("toy", r"^TOY ", parse_toy, r"^(?:tick|mark) ", (("^small$", "ToyMinor"), ("^background$", "ToyMark")), "ToyOther", "^background$"))
    registry.add_family(Family("toy_kept_ratio", "gauge", others=(("toy", "heap.occ_after / heap.occ_before"),)))
    registry.add_family(Family("toy_time_seconds", "summary", ("path", "host", "category"), others=(("toy", "duration_s"),), pause_only=True))
    yield
    for name in ("toy", "toy_kept_ratio", "toy_time_seconds"):
        registry.remove(name)


def test_a_dialect_and_families_from_outside(spark, tmp_path, toy):
    """From the diary to samples, beside the package's own dialects, in batch and in the job."""
    (tmp_path / "toy.log").write_text("".join(f"{x}\n" for x in TOY))
    (tmp_path / "serial.log").write_text((FIXTURES / "serial.log").read_text())
    lines = read_lines(spark, f"{tmp_path}/*.log")
    known = diary(lines)
    assert {(r.path.rsplit("/", 1)[1], r.collector, r.family) for r in known.collect()} == {("toy.log", "toy", "toy"), ("serial.log", "serial", "classic")}
    assert tell(TOY, added=(("toy", "^TOY "),)) == (False, "toy", "toy", None) and tell(TOY) is None
    events = parse_events(lines, known)
    own = events.where("family = 'toy'").orderBy("pos").collect()
    assert [(r.category, r.is_pause, r.duration_s, r.heap.occ_after) for r in own] == [("ToyMinor", True, 0.005, 4), ("ToyMark", False, 0.007, 9), ("ToyOther", True, 0.006, 3)]
    state = {(r.name, r.category): r for r in A.metric_state(observe(events)).where("path LIKE '%toy.log'").collect()}
    assert set(state) == {("toy_kept_ratio", None), ("toy_time_seconds", "ToyMinor"), ("toy_time_seconds", "ToyOther")} and state["toy_kept_ratio", None].last == 0.25
    assert outcomes(lines, known).where("path LIKE '%toy.log'").groupBy("outcome").count().collect().__len__() == 3
    pages = {}
    stream = spark.readStream.schema("path string, host string, split long, pos long, line string")
    lines.write.parquet(f"{tmp_path}/in")
    job = MetricJob(spark, f"file://{tmp_path}/state", publish=lambda epoch, s: pages.update({(r["name"], r["labels"].get("category")): r["value"] for r in s.collect()}))
    query = job.start(stream.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/checkpoint", availableNow=True)
    assert query.awaitTermination(120) and query.exception() is None
    assert pages["gc_toy_kept_ratio", None] == 0.25 and pages["gc_toy_time_seconds_count", "ToyMinor"] == 1 and pages["gc_collect_files", None] == 1


def test_registry_rules(toy):
    assert len(families()) == 105
    for bad in (registry.Dialect("toy", "x", parse_toy, "y"), registry.Dialect("g1", "x", parse_toy, "y"), registry.Dialect("a b", "x", parse_toy, "y")):
        with pytest.raises(ValueError):
            registry.add_dialect(bad)
    with pytest.raises(ValueError):
        registry.add_family(Family("toy_kept_ratio", "gauge"))
    with pytest.raises(ValueError):
        registry.add_family(Family("toy_more", "counter"))
    registry.remove("not there")
    registry.remove("toy_kept_ratio")
    assert len(families()) == 104


def test_rejects(spark):
    """Taken, blank and rejected lines are all lines, and the events of the taken ones are those of all."""
    lines = read_lines(spark, f"{FIXTURES}/*.log").cache()
    more = lines.limit(1).select(F.explode(F.array(F.lit(""), F.lit("[1.0s][info][gc] GC(7) Pause You"), F.lit(" "))).alias("line"), F.lit("none.log").alias("path"), "host", "split", "pos")
    lines = lines.unionByName(more).cache()
    known = diary(lines)
    told = {(r.outcome, r.reason): r["count"] for r in outcomes(lines, known).groupBy("outcome", "reason").count().collect()}
    assert sum(told.values()) == lines.count() and told["rejected", "unsupported file"] == 1 and told["blank", None] >= 2
    events, rejects = parse_with_rejects(lines, known)
    keys = ["path", "split", "pos", "category", "duration_s", "heap", "metaspace"]
    assert sorted(map(str, events.select(keys).collect())) == sorted(map(str, parse_events(lines, known).select(keys).collect())) and events.count() > 20
    assert rejects.count() == sum(n for (outcome, _), n in told.items() if outcome == "rejected")
    assert rejects.where("line = '[1.0s][info][gc] GC(7) Pause You'").first().reason == "unsupported file"


def test_heads_and_outcomes_of_files(spark, tmp_path):
    """A head ends after 512 lines whatever the file's size, a long line ends it, and files that can't be read are rows with their error that lead to quarantine."""
    big = tmp_path / "big.log"
    with big.open("w") as f:
        f.writelines(f"line {k}\n" for k in range(400_000))
    (tmp_path / "long.log").write_text("a\r\nb\rc\n" + "x" * 5000 + "\nafter\n")
    (tmp_path / "short.log").write_text("only")
    (tmp_path / "empty.log").write_text("")
    with gzip.open(tmp_path / "ok.log.gz", "wt") as f:
        f.write("packed\n")
    (tmp_path / "cut.log.gz").write_bytes(gzip.compress(b"line\n" * 50)[:-10])
    (tmp_path / "not.log.gz").write_text("no compression here")
    files = list_files(spark, f"{tmp_path}/*.log*")
    gone = files.limit(1).withColumn("path", F.lit(f"{tmp_path}/gone.log"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in probe_files(files.unionByName(gone)).collect()}
    heads = {name: r["head"] for name, r in rows.items() if r.error is None}
    assert heads["big.log"] == [f"line {k}" for k in range(512)] and heads["long.log"][:3] == ["a", "b", "c"] and len(heads["long.log"]) == 4 and 1024 < len(heads["long.log"][3]) <= 1026
    assert heads["short.log"] == ["only"] and "empty.log" not in rows and heads["ok.log.gz"] == ["packed"]
    assert sorted(n for n in rows if rows[n].error) == ["cut.log.gz", "gone.log", "not.log.gz"] and "FileNotFoundError" in rows["gone.log"].error
    now = datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.timezone.utc)
    outcomes_ = probe_files(files.unionByName(gone))
    shut = quarantined(outcomes_, now)
    assert sorted(r.path.rsplit("/", 1)[1] for r in shut.collect()) == ["cut.log.gz", "gone.log", "not.log.gz"]
    later = quarantined(outcomes_.where("false"), now + datetime.timedelta(minutes=59), shut)
    assert later.count() == 3 and quarantined(outcomes_.where("false"), now + datetime.timedelta(minutes=60), shut).count() == 0
    assert quarantined(outcomes_, now, most=2).count() == 2
    assert admit(files, now, idle_ms=10**14, quarantine=shut).count() == 4
    # broken beyond the head
    (tmp_path / "late.log.gz").write_bytes(gzip.compress("".join(f"line {k * k}\n" for k in range(100_000)).encode())[:-5000])
    late = list_files(spark, f"{tmp_path}/late*")
    assert probe_files(late).first().error is None and probe_files(late, whole=True).first().error.startswith("EOFError")
    # bytes that the head of a file takes don't grow with the file
    from heaplens.sources import lines as source

    read = []
    for size in (10_000, 400_000):
        with (tmp_path / "sized.txt").open("w") as f:
            f.writelines(f"line {k}\n" for k in range(size))
        opened = []
        source.open = lambda *a: opened.append(open(*a)) or opened[-1]
        try:
            source._head(str(tmp_path / "sized.txt"), 512, 1024)
        finally:
            del source.open
        read.append(len(opened))
        assert opened[0].closed
    assert read == [1, 1]
    before = int(next(x for x in pathlib.Path("/proc/self/io").read_text().splitlines() if x.startswith("rchar")).split()[1])
    source._head(str(big), 512, 1024)
    after = int(next(x for x in pathlib.Path("/proc/self/io").read_text().splitlines() if x.startswith("rchar")).split()[1])
    assert after - before < 512 * 1026 * 4 < big.stat().st_size
    heads = read_heads(spark, f"{tmp_path}/*.log*")
    assert heads.where("path LIKE '%big.log'").count() == 512 and diary(heads).count() == 0


def test_weights():
    assert weights("") == {"": 1.0} and weights("text/plain;version=0.0.4;q=0.5, application/openmetrics-text; q=0.9") == {"text/plain": 0.5, "application/openmetrics-text": 0.9}
    assert weights("GZIP;q=0, br;q=x") == {"gzip": 0.0, "br": 0.0} and weights("a;q=7") == {"a": 1.0}


def test_content_negotiation(spark):
    rows = [("gc_log_lines_total", "counter", "gc_log_lines_total", {"path": 'a"\\\n', "host": "h"}, 3.0), ("gc_load", "gauge", "gc_load", {"host": "h"}, float("inf")), ("gc_load", "gauge", "gc_load", {"host": "i"}, float("-inf")), ("gc_load", "gauge", "gc_load", {"host": "j"}, float("nan"))]
    scrape = Scrape()
    scrape.publish(0, spark.createDataFrame(rows, "family string, type string, name string, labels map<string,string>, value double"))
    server = scrape.serve("127.0.0.1", 0)
    try:

        def get(**headers):
            request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/metrics", headers={k.replace("_", "-"): v for k, v in headers.items()})
            with urllib.request.urlopen(request) as answer:
                return answer.headers, answer.read()

        headers, plain = get()
        assert headers["Content-Type"].startswith("text/plain; version=0.0.4") and headers["Content-Length"] == str(len(plain))
        assert plain.decode().splitlines() == [
            "# HELP gc_load gc load", "# TYPE gc_load gauge", 'gc_load{host="h"} +Inf', 'gc_load{host="i"} -Inf', 'gc_load{host="j"} NaN',
            "# HELP gc_log_lines_total gc log lines total", "# TYPE gc_log_lines_total counter", 'gc_log_lines_total{host="h",path="a\\"\\\\\\n"} 3.0',
        ]
        headers, own = get(Accept="application/openmetrics-text;version=1.0.0;q=0.9,text/plain;q=0.5", Accept_Encoding="gzip")
        assert headers["Content-Type"].startswith("application/openmetrics-text") and headers["Content-Encoding"] == "gzip"
        text = gzip.decompress(own).decode()
        assert text.endswith("# EOF\n") and "# TYPE gc_log_lines counter\n" in text and "# HELP gc_log_lines gc log lines\n" in text and text.count("gc_log_lines_total{") == 1
        assert get(Accept="text/plain, application/openmetrics-text;q=0.5")[0]["Content-Type"].startswith("text/plain") and get(Accept_Encoding="gzip;q=0")[0]["Content-Encoding"] is None
        assert scrape.text({"gc_load"}, True).count("\n") == 6
    finally:
        server.shutdown()

"""Quantiles over hopping windows against a plain count."""

import datetime
import math

from heaplens.operators.aggregate import QUANTILES, window_quantiles


def test_hopping_windows(spark):
    at = lambda ms: datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(milliseconds=ms)
    rows = [(p, ms, float(v)) for p in ("a", "b") for v, ms in enumerate((-7001, -10, 0, 5, 5, 999, 1000, 2500, 6000, 6001, 90_000))]
    df = spark.createDataFrame([("x", p, "h", at(ms), v) for p, ms, v in rows] + [("x", "a", "h", None, 1.0)], "name string, path string, host string, ts timestamp, value double")
    for width, step in ((6000, 1000), (2500, 1000), (1000, 1000)):
        wanted = set()
        for p in ("a", "b"):
            for begin in range(-20_000, 100_000, step):
                if own := sorted(v for q, ms, v in rows if q == p and begin <= ms < begin + width):
                    wanted.add((p, at(begin + width), len(own), *[own[max(math.ceil(len(own) * x) - 1, 0)] for x in QUANTILES]))
        got = window_quantiles(df, f"{width} milliseconds", f"{step} milliseconds")
        found = [(r.path, r.window_end.astimezone(datetime.timezone.utc), r.n, r.q0, r.q50, r.q75, r.q100) for r in got.collect()]
        assert len(found) == len(wanted) and set(found) == wanted
        assert "Expand" not in got._jdf.queryExecution().toString()  # an observation isn't copied for each window


def test_parts_of_a_stream_are_bounded(spark, tmp_path):
    """A stream is cut by time into parts of bounded size, without a summary of all times in memory; no row is lost, and rows of one time stay together."""
    from pyspark.sql import functions as F

    from heaplens.plans import everything

    rows = spark.range(5000).select(F.timestamp_seconds((F.col("id") * 7919) % 5000).alias("ts"), "id")
    parts = everything._by_time(rows, 10, f"{tmp_path}/a")
    ends = [p.agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).first() for p in parts]
    assert sum(e.n for e in ends) == 5000 and all(e.n <= 510 for e in ends) and all(x.b < y.a for x, y in zip(ends, ends[1:]))
    same = everything._by_time(rows.withColumn("ts", F.timestamp_seconds(F.lit(5))), 4, f"{tmp_path}/b")
    assert sum(p.count() for p in same) == 5000
    assert [p.count() for p in everything._by_time(rows.where("false"), 4, f"{tmp_path}/c")] == [0]


def test_stream_goes_by_batches_of_bounded_size(spark, monkeypatch):
    from heaplens.plans import everything, queries

    monkeypatch.setattr(everything, "STREAM_ROWS", 200)
    made, own = [], everything._stream
    monkeypatch.setattr(everything, "_stream", lambda spark, parts: made.append([p.count() for p in parts]) or own(spark, parts))
    data = "/root/testdata/sf0.001"
    got = queries.QUERIES["events_stream_tumbling"](spark, data)
    events = spark.read.parquet(f"{data}/events.parquet")
    assert len(made[0]) == -(-events.count() // 200) and max(made[0]) <= 220
    assert got.count() == events.selectExpr("user_id", "date_trunc('hour', ts)").distinct().count() and got.selectExpr("sum(n)").first()[0] == events.count()

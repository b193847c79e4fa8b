"""The metric algebra: counters, last values, summaries and quantiles over sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.catalog import families

#: Quantiles of the last-minute summaries.
QUANTILES = (0.0, 0.5, 0.75, 1.0)


def _exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def metric_state(observations: DataFrame, **more: Column) -> DataFrame:
    """name, path, host, category, n, total, last, split, pos of all families; counts, sums and last values are combined before they are shuffled. ``more`` are further aggregates of value, by name.

    Places are compared within a split first: what is combined there are plain numbers, which are kept by hash in memory for each series, where a place of two parts would have all observations sorted. Then the splits of each series are put together, one row each.
    """
    keys = ["name", "path", "host", "category"]
    if more:
        at = F.struct("split", "pos")
        grouped = observations.groupBy(*keys).agg(F.count("value").alias("n"), _exact_sum(F.col("value")).alias("total"), F.max_by("value", at).alias("last"), F.max(at).alias("at"), *[x.alias(name) for name, x in more.items()])
        return grouped.select(*keys, "n", "total", "last", "at.split", "at.pos", *more)
    within = observations.groupBy(*keys, "split").agg(F.count("value").alias("n"), F.sum(F.col("value").cast("decimal(38,12)")).alias("total"), F.max_by("value", "pos").alias("last"), F.max("pos").alias("pos"))
    at = F.struct("split", "pos")
    grouped = within.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"), F.max_by("last", at).alias("last"), F.max(at).alias("at"))
    return grouped.select(*keys, "n", "total", "last", "at.split", "at.pos")


def merge_state(before: DataFrame, now: DataFrame) -> DataFrame:
    """State after a batch: counts and sums add up, the later last value wins. A series without new values keeps its old ones."""
    rank = F.struct("age", "split", "pos")
    both = before.withColumn("age", F.lit(0)).unionByName(now.withColumn("age", F.lit(1)))
    grouped = both.groupBy("name", "path", "host", "category").agg(F.sum("n").alias("n"), _exact_sum(F.col("total")).alias("total"), F.max_by("last", rank).alias("last"), F.max(rank).alias("at"))
    return grouped.select("name", "path", "host", "category", "n", "total", "last", "at.split", "at.pos")


def log_lines(lines: DataFrame, name: str = "log_lines_total") -> DataFrame:
    """All lines of each file, blank and unparsed ones too."""
    return lines.groupBy("path", "host").agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "path", "host", "value")


def info_gauges(diaries: DataFrame, started: float, version: str, host: str) -> DataFrame:
    """The constant gauges: start time and version of the host, and a one for each open file. name, labels, value."""
    spark = diaries.sparkSession
    label = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*kv[1::2]))
    own = spark.range(1).select(F.inline(F.array(
        F.struct(F.lit("startup_timestamp_seconds").alias("name"), label("host", F.lit(host)).alias("labels"), F.lit(float(started)).alias("value")),
        F.struct(F.lit("exporter_version_info").alias("name"), label("version", F.lit(version), "host", F.lit(host)).alias("labels"), F.lit(1.0).alias("value")),
    )))
    files = diaries.select("path", "host").distinct().select(F.lit("collect_files").alias("name"), label("path", F.col("path"), "host", F.col("host")).alias("labels"), F.lit(1.0).alias("value"))
    return own.unionByName(files)


def samples(state: DataFrame, lines: DataFrame | None = None, quantiles: DataFrame | None = None, info: DataFrame | None = None, prefix: str = "gc_") -> DataFrame:
    """gc_samples: family, type, name, labels, value. Summaries give _count and _sum (and quantiles); empty families have no row."""
    kinds = {f.name: f.kind for f in families()}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    labels = F.map_filter(F.create_map(F.lit("path"), F.col("path"), F.lit("host"), F.col("host"), F.lit("category"), F.col("category")), lambda k, v: v.isNotNull())
    base = state.withColumn("type", kind[F.col("name")]).withColumn("labels", labels)
    entry = lambda suffix, value: F.struct(F.concat("name", F.lit(suffix)).alias("sample"), value.cast("double").alias("value"))
    parts = F.when(F.col("type") == "gauge", F.array(entry("", F.col("last")))).otherwise(F.array(entry("_count", F.col("n")), entry("_sum", F.col("total"))))
    out = base.select("name", "type", "labels", F.explode(parts).alias("p")).select("name", "type", "p.sample", "labels", "p.value")
    if quantiles is not None:
        q = quantiles.withColumn("labels", F.create_map(F.lit("path"), F.col("path"), F.lit("host"), F.col("host"), F.lit("quantile"), F.col("quantile").cast("string")))
        out = out.unionByName(q.select("name", F.lit("summary").alias("type"), F.col("name").alias("sample"), "labels", "value"))
    if lines is not None:
        counted = log_lines(lines).select("name", F.lit("counter").alias("type"), F.col("name").alias("sample"), F.create_map(F.lit("path"), F.col("path"), F.lit("host"), F.col("host")).alias("labels"), "value")
        out = out.unionByName(counted)
    if info is not None:
        out = out.unionByName(info.select("name", F.lit("gauge").alias("type"), F.col("name").alias("sample"), "labels", "value"))
    return out.select(F.concat(F.lit(prefix), "name").alias("family"), "type", F.concat(F.lit(prefix), "sample").alias("name"), "labels", "value")


def _micros(spark: SparkSession, length: str) -> int:
    """Microseconds of an interval such as "10 minutes"."""
    return spark.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {length}"))).first()[0]


def window_quantiles(observations: DataFrame, width: str = "60 seconds", step: str = "10 seconds", quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """name, path, host, window_end, n and one column for each quantile, over hopping event-time windows (exact, for batches).

    Time is cut into slices of ``width`` (in whole steps). The windows that begin in a slice hold values of that slice and the next one at most, so an observation goes to
    two slices, not to each of its windows, and what is gathered in one row are the values of a series within two slices. A time of null is in no window.
    """
    w, s = (_micros(observations.sparkSession, x) for x in (width, step))
    steps = -(-w // s)  # windows that begin within a slice
    div = lambda x, y: F.expr(f"{x} div {y} - if({x} % {y} < 0, 1, 0)")
    # windows are numbered by their begin, in steps; those of an observation begin after its time less the width
    rows = observations.where("ts IS NOT NULL AND value IS NOT NULL").select("name", "path", "host", F.unix_micros("ts").alias("t"), "value")
    rows = rows.withColumn("before", F.col("t") - w).withColumns({"first": div("before", s) + 1, "last": div("t", s)}).where("first <= last")
    rows = rows.withColumns({"from": div("first", steps), "to": div("last", steps)})
    rows = rows.select("name", "path", "host", F.explode(F.sequence("from", "to")).alias("slice"), F.struct("value", "first", "last").alias("of"))
    slices = rows.groupBy("name", "path", "host", "slice").agg(F.sort_array(F.collect_list("of")).alias("told"))
    begins = F.array_distinct(F.flatten(F.transform("told", lambda x: F.sequence(F.greatest(x["first"], F.col("slice") * steps), F.least(x["last"], F.col("slice") * steps + (steps - 1))))))
    windows = slices.select("name", "path", "host", "told", F.explode(begins).alias("begin"))
    windows = windows.withColumn("own", F.filter("told", lambda x: (x["first"] <= F.col("begin")) & (F.col("begin") <= x["last"])))
    at = lambda q: F.get("own", F.greatest(F.ceil(F.size("own") * F.lit(q)) - 1, F.lit(0)).cast("int"))["value"]
    return windows.select("name", "path", "host", F.timestamp_micros(F.col("begin") * s + w).alias("window_end"), F.size("own").cast("bigint").alias("n"), *[at(q).alias(f"q{round(q * 100)}") for q in quantiles])


def trailing_quantiles(observations: DataFrame, seconds: int = 60, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Each observation with the exact quantiles of its series over the ``seconds`` up to it.

    Time is cut into slices of ``seconds``; a slice and the one before it hold all that the slice's observations look back on, so every task has the
    observations of two slices of a series at most, however long the series is.
    """
    own = F.floor(F.col("ts").cast("double") / seconds)
    rows = observations.select("name", "path", "host", "split", "pos", "ts", "value", F.explode(F.array(own, own + 1)).alias("slice")).withColumn("own", F.col("slice") == own)
    over = W.partitionBy("name", "path", "host", "slice").orderBy(F.col("ts").cast("double")).rangeBetween(-seconds, 0)
    rows = rows.withColumn("recent", F.sort_array(F.collect_list("value").over(over))).where("own")
    at = lambda q: F.get("recent", F.greatest(F.ceil(F.size("recent") * F.lit(q)) - 1, F.lit(0)).cast("int"))
    return rows.select("name", "path", "host", "split", "pos", "ts", F.size("recent").cast("bigint").alias("n"), *[at(q).alias(f"q{round(q * 100)}") for q in quantiles])


#: A ring has this many buckets, of equal length, for what a summary of quantiles looks back on.
RING = 6


def ring_sketches(observations: DataFrame, at: Column, seconds: int = 60, size: int = 200) -> DataFrame:
    """name, path, host, bucket, sketch: the values of each series within each bucket of ``seconds`` / 6, numbered by time ``at``, as a mergeable sketch.

    A sketch (KLL) takes a bounded number of bytes however many values it has seen; with ``size`` 200 the rank of a quantile is off by some 0.013, least and largest values are exact.
    """
    bucket = F.floor(at.cast("double") / (seconds / RING)).cast("bigint")
    return observations.groupBy("name", "path", "host", bucket.alias("bucket")).agg(F.kll_sketch_agg_double("value", size).alias("sketch"))


def merge_rings(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sketches of equal series and bucket as one."""
    return before.unionByName(now).groupBy("name", "path", "host", "bucket").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def in_ring(now: Column, seconds: int = 60) -> Column:
    """Whether a bucket is one of the latest six at ``now``."""
    current = F.floor(now.cast("double") / (seconds / RING)).cast("bigint")
    return (F.col("bucket") > current - RING) & (F.col("bucket") <= current)


def ring_quantiles(ring: DataFrame, now: Column, seconds: int = 60, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """name, path, host, quantile, value over the latest six buckets: what a scrape shows. The values come from merged sketches."""
    merged = ring.where(in_ring(now, seconds)).groupBy("name", "path", "host").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(q)) for q in quantiles]))
    return merged.select("name", "path", "host", F.explode(F.map_from_arrays(F.array(*[F.lit(str(q)) for q in quantiles]), at)).alias("quantile", "value"))


def hop_quantiles(observations: DataFrame, seconds: int = 60, quantiles: Sequence[float] = QUANTILES, size: int = 200) -> DataFrame:
    """As ``window_quantiles`` over windows of ``seconds`` in steps of a sixth, from sketches: each observation goes into one sketch, and a window merges six of them, so rows aren't multiplied by the windows they are in."""
    sketches = ring_sketches(observations, F.col("ts"), seconds, size)
    ends = sketches.select("name", "path", "host", F.explode(F.sequence(F.col("bucket") + 1, F.col("bucket") + RING)).alias("end"), "sketch")
    merged = ends.groupBy("name", "path", "host", "end").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"q{round(q * 100)}")
    end = F.timestamp_millis((F.col("end") * F.lit(round(1000 * seconds / RING))).cast("bigint")).alias("window_end")
    return merged.select("name", "path", "host", end, F.kll_sketch_get_n_double("sketch").alias("n"), *[at(q) for q in quantiles])


def latest_quantiles(observations: DataFrame, now: Column, seconds: int = 60, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """name, path, host, quantile, value over the last ``seconds`` before ``now``: what a scrape shows."""
    recent = observations.where((F.col("ts") > now - F.make_dt_interval(secs=F.lit(float(seconds)))) & (F.col("ts") <= now))
    exact = F.map_from_arrays(F.array(*[F.lit(str(q)) for q in quantiles]), F.array(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)") for q in quantiles]))
    return recent.groupBy("name", "path", "host").agg(exact.alias("q")).select("name", "path", "host", F.explode("q").alias("quantile", "value"))


def expire(state: DataFrame, seen: DataFrame, now: Column, idle_ms: int = 3_600_000) -> DataFrame:
    """State (or any table with a path) without the rows of files idle for longer than ``idle_ms``; seen: path, last_seen."""
    alive = seen.groupBy("path").agg(F.max("last_seen").alias("last_seen")).where(F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(idle_ms / 1000)))
    return state.join(alive.select("path"), "path", "left_semi")

"""The continuous job: lines of each micro-batch to events, events to metric state, state to the scrape page."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import aggregate as A
from ..operators.events import parse_known
from ..operators.observations import observe
from ..plans.catalog import families
from .changes import ChangeLog
from .files import follow

VERSION = "1"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_SERIES = ["name", "path", "host", "category"]


class MetricJob:
    """Dialect and unfinished lines of each file are in Spark's state store, by file (see ``FileState``); series, sketches of the last minute and line counts are in ``folder``, as tables of which each batch writes the rows that it changes.

    A batch's lines are parsed once; what they sum up to, a row for each series that they touch, is merged with those rows of before. A batch that is run again gives the same: its time is that of Spark's own log of batches. Lines of an event whose last line hasn't come yet wait in
    the state store. All series of a file that is idle for longer than ``idle_ms`` go when its timer runs out: state, sketches, line count, info gauge, held lines. What is known of its dialect stays for ``memory`` times as long.
    """

    def __init__(
        self, spark: SparkSession, folder: str, idle_ms: int = 3_600_000, strict_zgc: bool = False, publish: Callable[[int, DataFrame], None] | None = None, host: str = "localhost", prefix: str = "gc_",
        header_lines: int = 512, max_header_line: int = 1024, quantile_seconds: int = 60, memory: int = 24, clock: Callable[[], float] = time.time, snapshot_every: int = 32,
    ) -> None:
        self.spark, self.folder, self.idle_ms, self.strict_zgc, self.publish = spark, folder.rstrip("/"), idle_ms, strict_zgc, publish
        self.host, self.prefix, self.header_lines, self.max_header_line, self.quantile_seconds, self.memory = host, prefix, header_lines, max_header_line, quantile_seconds, memory
        self.started, self.last_epoch = clock(), -1
        log = lambda name, keys, schema: ChangeLog(spark, f"{self.folder}/{name}", keys, schema, snapshot_every)
        self.series = log("series", _SERIES, "name string, path string, host string, category string, n bigint, total double, last double, split bigint, pos bigint")
        self.rings = log("rings", ["name", "path", "host", "bucket"], "name string, path string, host string, bucket bigint, sketch binary")
        self.files = log("files", ["path", "host"], "path string, host string, n bigint, collector string")

    def state(self) -> DataFrame:
        """The metric state after the last batch of this job object."""
        return self.series.as_of(self.last_epoch)

    def batch(self, rows: DataFrame, epoch: int) -> None:
        """Merge a batch of ``follow`` into the tables and publish them."""
        path = f"{self.folder}/batches/epoch={epoch}"
        rows.write.mode("overwrite").parquet(path)  # runs the stateful operator, once
        rows = self.spark.read.schema(rows.schema).parquet(path)
        told = rows.groupBy("unified", "family").agg(F.max("at_ms").alias("at"), F.count_if(F.col("kind") == "line").alias("lines")).collect()  # a row for each dialect
        if not told:  # a batch without data, for timers
            return self._forget(epoch)
        now = F.timestamp_millis(F.lit(max(r.at for r in told)).cast("bigint"))
        closed = rows.where("kind = 'closed'").select("path", "host").distinct()
        seen = rows.where("kind = 'file'").groupBy("path", "host").agg(F.sum("n").alias("n"), F.max("collector").alias("collector"))
        partial = ring = None
        if kinds := sorted((r.unified, r.family) for r in told if r.lines):
            lines = rows.where("kind = 'line'").select("path", "host", "split", "pos", "line", "unified", "collector", "family", "region_kib")
            partial = f"{self.folder}/observed/epoch={epoch}"
            # a row for each series touched; those of the last minute's families also bring a sketch
            last_minute = [f.name for f in families() if f.quantiles]
            sketch = F.kll_sketch_agg_double(F.when(F.col("name").isin(last_minute), F.col("value")))
            A.metric_state(observe(parse_known(lines, kinds), self.strict_zgc), sketch=sketch).write.mode("overwrite").parquet(partial)
            found = self.spark.read.parquet(partial)
            partial = found.drop("sketch")
            bucket = F.floor(now.cast("double") / (self.quantile_seconds / A.RING)).cast("bigint")
            ring = found.where(F.col("name").isin(last_minute)).select("name", "path", "host", bucket.alias("bucket"), "sketch")
        series = self._merge(self.series, partial, closed, epoch, A.merge_state)
        rings = self._merge(self.rings, ring, closed, epoch, A.merge_rings, A.in_ring(now, self.quantile_seconds))
        files = self._merge(self.files, seen, closed, epoch, lambda old, new: old.unionByName(new).groupBy("path", "host").agg(F.sum("n").alias("n"), F.max("collector").alias("collector")))
        self.last_epoch = epoch
        self._forget(epoch - 2)
        if self.publish:
            self.publish(epoch, self._samples(series, rings, files, now))

    def _merge(self, log: ChangeLog, new: DataFrame | None, closed: DataFrame, epoch: int, merge, keep=None) -> DataFrame:
        """Merge the rows of before that a batch touches with its own; rows of closed files go, as do those without ``keep`` (of touched series) when they are next read."""
        before = log.as_of(epoch - 1)
        if keep is not None:
            before = before.where(keep)
        gone = before.join(closed, ["path", "host"], "left_semi")
        if new is None:
            return log.write(before.where("false"), gone, epoch)
        # a file that is closed and seen in one batch begins anew
        kept = before.join(closed, ["path", "host"], "left_anti").join(new.select(*[F.col(k).alias(f"k_{k}") for k in log.keys]), _same(log.keys), "left_semi")
        again = gone.join(new.select(*[F.col(k).alias(f"k_{k}") for k in log.keys]), _same(log.keys), "left_anti")
        return log.write(merge(kept, new), again, epoch)

    def _forget(self, epoch: int) -> None:
        """Delete a batch's own folders through Spark's own file system."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in ("batches", "observed"):
            fs.delete(fs_path(f"{self.folder}/{name}/epoch={epoch}"), True)

    def _samples(self, series: DataFrame, rings: DataFrame, files: DataFrame, now) -> DataFrame:
        known = files.where("collector IS NOT NULL")
        samples = A.samples(series, quantiles=A.ring_quantiles(rings, now, self.quantile_seconds), info=A.info_gauges(known, self.started, VERSION, self.host), prefix=self.prefix)
        name = F.lit(f"{self.prefix}log_lines_total")
        counted = files.select(name.alias("family"), F.lit("counter").alias("type"), name.alias("name"), F.create_map(F.lit("path"), "path", F.lit("host"), "host").alias("labels"), F.col("n").cast("double").alias("value"))
        return samples.unionByName(counted)

    def start(self, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of lines (path, host, split, pos, line); trigger as in ``DataStreamWriter.trigger``. The query keeps its state in the RocksDB store; the session's own settings are left as they were. Timers run out in batches without data too, but not with a trigger that ends."""
        # a trigger that ends would never do so with batches without data, which timers ask for
        ends = bool({"availableNow", "once"} & set(trigger))
        settings = {_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(not ends).lower()}
        before = {k: self.spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            rows = follow(lines.select("path", "host", "split", "pos", "line"), self.idle_ms, self.memory, self.header_lines, self.max_header_line)
            return rows.writeStream.outputMode("update").foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)


def _same(keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    return out


def stream_quantiles(observations: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "1 minute", accuracy: int = 10_000) -> DataFrame:
    """Quantiles of a stream of observations over hopping event-time windows, approximate, with a watermark that lets state go."""
    grouped = observations.withWatermark("ts", late).groupBy("name", "path", "host", F.window("ts", width, step)).agg(F.count("value").alias("n"), F.percentile_approx("value", list(A.QUANTILES), accuracy).alias("q"))
    return grouped.select("name", "path", "host", F.col("window.end").alias("window_end"), "n", "q")

"""The continuous job from settings: follow files, keep the state, serve the page.

    python -m heaplens.app settings.json hdfs:///gc/state hdfs:///gc/checkpoint
"""

from __future__ import annotations

import json
import logging
import logging.handlers
import sys

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from .config import LogConfig
from .sources.tail import TailSource
from .streaming.job import MetricJob
from .streaming.serve import Scrape

log = logging.getLogger("heaplens")


def start(spark: SparkSession, config: LogConfig, state: str, checkpoint: str, **trigger) -> tuple[StreamingQuery, Scrape]:
    """Register the tail source and start the job; the caller serves the scrape."""
    spark.dataSource.register(TailSource)
    options = {
        "globs": ",".join(config.globs), "regexes": ",".join(config.regexes), "host": config.host, "linesPerSecond": 0 if config.lines_per_second >= 2**31 - 1 else config.lines_per_second, "idleTimeout": config.idle_timeout,
        "watchInterval": config.watch_interval, "scanFilesPerSecond": config.scan_files_per_second, "batchLines": config.batch_size, "bufferBytes": config.buffer_size, "maxBytesPerTrigger": config.max_bytes_per_trigger, "newFileOffsets": config.new_file_offsets,
    }
    reader = spark.readStream.format("gclog_tail").options(**options)
    scrape = Scrape()
    job = MetricJob(spark, state, config.idle_timeout, config.strict_zgc, scrape.publish, config.host, config.prefix, config.header_lines, config.max_header_line)
    query = job.start(reader.load(), checkpoint, **trigger or {"processingTime": f"{config.read_interval} milliseconds"})
    log.info("following %s", [*config.globs, *config.regexes])
    return query, scrape


def main(argv: list[str]) -> None:
    day = logging.handlers.TimedRotatingFileHandler("heaplens.log", when="midnight", backupCount=7)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=[logging.StreamHandler(), day])
    settings, state, checkpoint = argv
    with open(settings, encoding="utf-8") as f:
        config = LogConfig.from_mapping(json.load(f))
    query, scrape = start(SparkSession.builder.appName("heaplens").getOrCreate(), config, state, checkpoint)
    scrape.serve(config.listen_host, config.port)
    query.awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])

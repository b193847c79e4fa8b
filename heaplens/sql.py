"""Views for Spark SQL over a set of log files."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from .operators.aggregate import info_gauges, metric_state, samples
from .operators.dialect import diary
from .operators.events import dialects, parse_events
from .operators.observations import observe
from .operators.rejects import outcomes
from .sources.lines import heads_of, lines_in, list_files


def register(spark: SparkSession, patterns: list[str] | str, host: str = "localhost", strict_zgc: bool = False, prefix: str = "gc_", started: float | None = None) -> None:
    """Create the temporary views gc_lines, gc_diary, gc_events, gc_rejects, gc_observations and gc_samples. Files are listed and the diary, from their heads, is told once; ``started`` (default: now) is the start time that the samples tell."""
    files = list_files(spark, patterns).localCheckpoint()
    lines = lines_in(files, host)
    known = diary(heads_of(spark, files, host))
    events = parse_events(lines, known, dialects(known))
    observed = observe(events, strict_zgc)
    views = {"gc_lines": lines, "gc_diary": known, "gc_events": events, "gc_rejects": outcomes(lines, known).where("outcome = 'rejected'").drop("outcome"), "gc_observations": observed, "gc_samples": samples(metric_state(observed), lines, info=info_gauges(known, time.time() if started is None else started, "1", host), prefix=prefix)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)

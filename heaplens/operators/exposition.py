"""The scrape page: samples as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(samples: DataFrame) -> DataFrame:
    """Samples but those of creation times."""
    return samples.where(~F.col("name").endswith("_created"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _number(value: Column) -> Column:
    """A value as the formats write it."""
    return F.when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").otherwise(value.cast("string"))


def both_formats(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """family, k, name, line, open_line: each line of the page in the plain text format and in OpenMetrics, from one reading of the samples.

    The formats differ in the heads of counters, which OpenMetrics names without the ``_total`` of their samples, and in what help texts escape.
    """
    rows = visible(samples)
    if names:
        rows = rows.where(F.col("name").isin(names))
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    sample = F.concat("name", F.lit("{"), F.array_join(entries, ","), F.lit("} "), _number(F.col("value")))
    bare = F.when(F.col("type") == "counter", F.regexp_replace("family", "_total$", "")).otherwise(F.col("family"))
    head = lambda word, name, text: F.concat(F.lit(f"# {word} "), name, F.lit(" "), text)
    help_text, kind = F.replace("family", F.lit("_"), F.lit(" ")), F.col("type")
    # every sample brings its family's head along, of which one stays; so the samples are read once
    lines = [
        (0, F.lit(""), head("HELP", F.col("family"), help_text), head("HELP", bare, _escaped(F.replace(bare, F.lit("_"), F.lit(" "))))),
        (1, F.lit(""), head("TYPE", F.col("family"), kind), head("TYPE", bare, kind)), (2, F.col("name"), sample, sample),
    ]
    return rows.select("family", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), name.alias("name"), text.alias("line"), other.alias("open_line")) for k, name, text, other in lines]))).distinct()


def render(samples: DataFrame, names: list[str] | None = None, openmetrics: bool = False) -> DataFrame:
    """family, line: per family its help and type once, then its samples in order of name and labels.

    ``names`` picks samples by name, as a scrape may ask for. Families without a sample have no lines. An OpenMetrics page ends with a line of its own (of an empty family name, last).
    """
    line = "open_line" if openmetrics else "line"
    rows = both_formats(samples, names).select("family", "k", "name", F.col(line).alias("line"), F.lit(0).alias("end"))
    if openmetrics:
        rows = rows.unionByName(samples.sparkSession.createDataFrame([("", 0, "", "# EOF", 1)], "family string, k int, name string, line string, end int"))
    return rows.orderBy("end", "family", "k", "name", "line").select("family", "line")


def page(samples: DataFrame, names: list[str] | None = None) -> str:
    """The page as one string. Its size follows the number of series, not of log lines, as a scrape's must."""
    return "".join(f"{row.line}\n" for row in render(samples, names).toLocalIterator())

"""Observations: one event becomes a row for each family that it has a value of."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Family, families, value


def _chosen(strict_zgc: bool, names: set[str] | None) -> list[Family]:
    return [f for f in families(strict_zgc) if (f.classic or f.g1 or f.zgc or f.others) and (names is None or f.name in names)]


def asked(names: set[str], strict_zgc: bool = False) -> set[str]:
    """What the families read of gc_events: names as ``parse_events`` takes them for its columns."""
    own = " ".join(x for f in _chosen(strict_zgc, names) for x in (f.classic, f.g1, f.zgc, *(sql for _, sql in f.others)) if x)
    return set(re.findall(r"zgc\.\w+|\w+", own))


def observe(events: DataFrame, strict_zgc: bool = False, names: set[str] | None = None, prefix: str = "") -> DataFrame:
    """gc_observations: name, path, host, category, split, pos, ts, value. ``names`` picks families before anything is computed.

    Families without a value for an event (a missing pool, a negative count, a time of zero) have no row.
    """
    chosen = _chosen(strict_zgc, names)
    pairs = F.array(*[F.struct(F.lit(prefix + f.name).alias("name"), F.lit("category" in f.labels).alias("by_category"), value(f).alias("value")) for f in chosen])
    # the pairs are a column of their own, as the generator would interpret them
    rows = events.select("path", "host", "category", "split", "pos", "ts", pairs.alias("pairs"))
    rows = rows.select("path", "host", "category", "split", "pos", "ts", F.explode(F.filter("pairs", lambda x: x["value"].isNotNull())).alias("o"))
    return rows.select("o.name", "path", "host", F.when(F.col("o.by_category"), F.col("category")).alias("category"), "split", "pos", "ts", "o.value")

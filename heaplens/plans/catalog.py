"""The catalog of metric families: what each is called, how it is summed up, and its value by family of collectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """exprs: SQL over the columns of gc_events by source (classic, g1, zgc); pause_only: observed for pauses only."""

    name: str
    kind: str  # gauge, summary or counter
    labels: tuple[str, ...] = ("path", "host")
    classic: str | None = None
    g1: str | None = None
    zgc: str | None = None
    pause_only: bool = False
    quantiles: bool = False
    others: tuple[tuple[str, str], ...] = ()  # (dialect, SQL) of dialects that a user has added

    @property
    def help(self) -> str:
        return self.name.replace("_", " ")

    @property
    def aggregate(self) -> str:
        return {"counter": "count", "gauge": "last", "summary": "count, sum"}[self.kind] + (", quantiles" if self.quantiles else "")


def _bytes(expr: str) -> str:
    return f"({expr}) * 1024"


def _at_least_zero(expr: str) -> str:
    return f"CASE WHEN {expr} >= 0 THEN {expr} END"


def _above_zero(expr: str) -> str:
    return f"CASE WHEN {expr} > 0 THEN {expr} END"


def _or_zero(expr: str, test: str = ">= 0") -> str:
    return f"coalesce(CASE WHEN {expr} {test} THEN {expr} END, 0)"


def zgc_expressions(strict: bool) -> dict[str, str]:
    """The two places where faithful results differ from strict ones: the snapshot at relocate end, and the unit of live memory at mark end."""
    return {"end": "zgc.relocate_end" if strict else "zgc.relocate_start", "live": _bytes("zgc.live.mark_end") if strict else "zgc.live.mark_end"}


# Phases of a cycle in order, with the stem of their family's name and whether they count as pause.
ZGC_PHASES = (
    ("pause_mark_start", "pause_mark_start_duration_seconds", True),
    ("conc_mark", "concurrent_mark_duration_seconds", False),
    ("conc_mark_free", "concurrent_mark_free_duration_seconds", False),
    ("pause_mark_end", "pause_mark_end_duration_seconds", True),
    ("conc_nonstrong", "process_non_strong_references_duration_seconds", False),
    ("conc_reset_reloc", "concurrent_reset_relocationset_duration_seconds", False),
    ("conc_select_reloc", "concurrent_select_relocationset_duration_seconds", False),
    ("pause_reloc_start", "pause_relocate_start_duration_seconds", True),
    ("conc_reloc", "concurrent_relocate_duration_seconds", False),
)
# Reference kinds with the names of their count and of their pause family.
REFERENCES = (
    ("soft", "soft_references", "soft_reference_pause_duration_seconds"),
    ("weak", "weak_references", "weak_reference_pause_seconds"),
    ("final", "final_references", "final_reference_pause_duration_seconds"),
    ("phantom", "phantom_references", "phantom_reference_pause_duration_seconds"),
    ("jni", "jni_weak_references", "jni_weak_reference_pause_duration_seconds"),
)
MMU_MS = (2, 5, 10, 20, 50, 100)


def families(strict_zgc: bool = False) -> list[Family]:
    """All 103 families, in the order of the catalog; names go without the prefix."""
    z = zgc_expressions(strict_zgc)
    total = " + ".join(f"zgc.{p}_ms" for p, _, _ in ZGC_PHASES)
    paused = " + ".join(f"zgc.{p}_ms" for p, _, pause in ZGC_PHASES if pause)
    with_category = ("path", "host", "category")
    d = "duration_s"
    out = [
        Family("startup_timestamp_seconds", "gauge", ("host",)),
        Family("exporter_version_info", "gauge", ("version", "host")),
        Family("collect_files", "gauge"),
        Family("log_lines_total", "counter"),
        Family("event_duration_seconds", "summary", with_category, d, d, f"({total}) / 1000"),
        Family("event_last_minute_duration_seconds", "summary", ("path", "host"), d, d, f"({total}) / 1000", quantiles=True),
        Family("event_last_minute_pause_duration_seconds", "summary", ("path", "host"), d, d, f"({paused}) / 1000", True, True),
        Family("event_pause_duration_seconds", "summary", with_category, d, d, f"({paused}) / 1000", True),
    ]
    snapshot = lambda s, part: _bytes(f"{s}.used" if part == "occupancy" else f"{s}.used + {s}.free")
    for when, field_, zsnap in (("before", "before", "zgc.mark_start"), ("after", "after", z["end"])):
        for part, key in (("occupancy", "occ"), ("size", "size")):
            out.append(Family(f"heap_{part}_{when}_collection_bytes", "gauge", classic=_bytes(f"heap.{key}_{field_}"), g1=_bytes(f"heap.{key}_{field_}"), zgc=snapshot(zsnap, part)))
    for when in ("before", "after"):
        young = f"{_or_zero(f'eden.occ_{when}')} + {_or_zero(f'survivor.occ_{when}')}"
        sizes = f"{_or_zero(f'eden.size_{when}', '> 0')} + {_or_zero('survivor.size', '> 0')}"
        out.append(Family(f"young_occupancy_{when}_collection_bytes", "gauge", classic=_bytes(f"young.occ_{when}"), g1=f"CASE WHEN is_pause THEN {_bytes(young)} END"))
        out.append(Family(f"young_size_{when}_collection_bytes", "gauge", classic=_bytes(f"young.size_{when}"), g1=f"CASE WHEN is_pause THEN {_bytes(sizes)} END"))
    for pool_, g1 in (("old", False), ("metaspace", True)):
        for when in ("before", "after"):
            for part, key in (("occupancy", "occ"), ("size", "size")):
                value = _bytes(f"{pool_}.{key}_{when}")
                out.append(Family(f"{pool_}_{part}_{when}_collection_bytes", "gauge", classic=value, g1=value if g1 else None))
    for key, name in (("class_unload_s", "cms_class_unloading_process_duration_seconds"), ("symbol_s", "cms_symbol_table_process_duration_seconds"), ("string_s", "cms_string_table_process_duration_seconds"), ("symbol_string_s", "cms_symbol_and_string_table_process_seconds")):
        out.append(Family(name, "summary", classic=f"CASE WHEN category LIKE 'CMS%' THEN {_above_zero(f'cms.{key}')} END", pause_only=True))
    for kind, counted, paused_name in REFERENCES:
        n, s = f"refs.{kind}_n", f"refs.{kind}_s"
        out.append(Family(counted, "gauge", classic=n, g1=n, pause_only=True))
        if kind == "phantom":
            out.append(Family("free_phantom_references", "gauge", classic="refs.phantom_freed_n", g1="refs.phantom_freed_n", pause_only=True))
        out.append(Family(paused_name, "summary", classic=s, g1=s, pause_only=True))
    # The names of these families aren't regular.
    for name, expr, test in (
        ("g1_eden_occupancy_after_collection_bytes", "eden.occ_after", _at_least_zero),
        ("g1_eden_heap_occupancy_before_collection_bytes", "eden.occ_before", _at_least_zero),
        ("g1_eden_size_after_collection_bytes", "eden.size_after", _above_zero),
        ("g1_eden_size_before_collection_bytes", "eden.size_before", _above_zero),
        ("g1_survivor_heap_occupancy_after_collection_bytes", "survivor.occ_after", _at_least_zero),
        ("g1_survivor_heap_occupancy_before_collection_bytes", "survivor.occ_before", _at_least_zero),
        ("g1_survivor_size_bytes", "survivor.size", _above_zero),
    ):
        out.append(Family(name, "gauge", g1=_bytes(test(expr))))
    for space in ("eden", "survivor", "old", "humongous", "archive"):
        for key, word in (("before", "before_collection"), ("after", "after_collection"), ("assigned", "assign")):
            out.append(Family(f"g1_{space}_{word}_regions", "gauge", g1=_at_least_zero(f"r_{space}.{key}")))
    for phase, stem, _ in ZGC_PHASES:
        out.append(Family(f"zgc_{stem}", "summary", zgc=f"zgc.{phase}_ms / 1000"))
    for minutes in (1, 5, 15):
        out.append(Family(f"zgc_{minutes}m_cpu_load", "gauge", zgc=f"zgc.load{minutes}"))
    for ms in MMU_MS:
        out.append(Family(f"zgc_{ms}ms_mmu_ratio", "gauge", zgc=f"zgc.mmu[{ms}] / 100"))
    for at, snap in (("mark_start", "zgc.mark_start"), ("mark_end", "zgc.mark_end"), ("relocate_start", "zgc.relocate_start"), ("relocate_end", z["end"])):
        for part in ("used", "free"):
            out.append(Family(f"zgc_{at}_{part}_bytes", "gauge", zgc=_bytes(f"{snap}.{part}")))
    for kind in ("live", "allocated", "garbage"):
        for at in ("mark_end", "reclaim_start", "reclaim_end"):
            name = "zgc_garbage_reclaim_start_heap_bytes" if (kind, at) == ("garbage", "reclaim_start") else f"zgc_{kind}_{at}_bytes"
            out.append(Family(name, "gauge", zgc=z["live"] if (kind, at) == ("live", "mark_end") else _bytes(f"zgc.{kind}.{at}")))
    for kind in ("reclaimed", "memory"):
        for at in ("reclaim_start", "reclaim_end"):
            out.append(Family(f"zgc_{kind}_{at}_bytes", "gauge", zgc=_bytes(f"zgc.{kind}.{at}")))
    for part in ("used", "committed", "reserved"):
        out.append(Family(f"zgc_metaspace_{part}_bytes", "gauge", zgc=_bytes(f"zgc.metaspace.{part}")))
    return out + ADDED


#: Families that a user has added (see ``registry``).
ADDED: list[Family] = []


def value(family: Family) -> Column:
    """The observation of a family for one event, null if there is none."""
    out = None
    for source, expr in (("classic", family.classic), ("g1", family.g1), ("zgc", family.zgc), *family.others):
        if expr:
            test = (F.col("family") == source) & (F.col("is_pause") if family.pause_only else F.lit(True))
            x = F.expr(expr).cast("double")
            out = F.when(test, x) if out is None else out.when(test, x)
    return out


def catalog(spark: SparkSession, prefix: str = "gc_") -> DataFrame:
    """The families as a table: name, type, help, labels, aggregate."""
    rows = [(prefix + f.name, f.kind, f.help, list(f.labels), f.aggregate) for f in families()]
    return spark.createDataFrame(rows, "name string, type string, help string, labels array<string>, aggregate string")

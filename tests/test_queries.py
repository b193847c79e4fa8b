import pandas as pd
import pytest

from heaplens.plans import everything, queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["families_g1", "families_g1_legacy", "families_cms", "categories_classic_all", "categories_g1_all", "text_files_multi_glob", "text_files_regex", "last_minute_quantiles_range"])
def test_against_sql(spark, name):
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
        want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    order = sorted(got.columns)
    assert order == sorted(want.columns) and len(got) == len(want)
    a, b = (df[order].sort_values(order, ignore_index=True) for df in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_all_categories_and_families_have_a_query():
    from heaplens.functions import category
    from heaplens.plans.catalog import families

    labelled = set(everything.G1_LABELS.values()) | set(everything.ZGC_CAUSES.values()) | set(everything.CLASSIC_LINES.values())
    assert labelled == {c for rules in (category.CLASSIC, category.G1, category.ZGC) for _, c in rules} | {"Unknown", "G1Unknown", "ZGCUnknown"}
    told = set(everything.ZGC_VALUES) | set(everything.G1_VALUES) | set(everything.G1_BLOCK_VALUES) | set(everything.CLASSIC_VALUES) | set(everything.CMS_VALUES)
    rest = {"startup_timestamp_seconds", "exporter_version_info", "collect_files", "log_lines_total", "event_duration_seconds", "event_last_minute_duration_seconds", "event_pause_duration_seconds"}  # have queries of their own
    assert {f.name for f in families()} == told | rest

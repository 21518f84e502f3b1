"""A sample of registered queries against DuckDB on the smallest tables; ALL_QUERIES=1 runs every one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = """
    pipe01_site_audit pipe02_page_priority pipe04_cannibalization_groups pipe09_priority_matrix agg03_window_metrics agg17_prediction_accuracy
    jn01_page_resolution jn08_link_counts src01_page_signals src07_robots_rules chg01_file_to_route snk02_page_snapshot_upsert win09_parameter_variants
    udf01_failing_rules jn09_duplicate_groups jn10_robots_longest_match str05_changed_pages snk07_audit_report pipe16_extraction_agreement
""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 200


@pytest.mark.parametrize("key", list(queries()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, key):
    text, ok = compare(spark, duck(SF), key, queries()[key], oracle_sql().get(key), SF)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry(spark).limit(5).count() > 0

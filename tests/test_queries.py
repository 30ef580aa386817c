"""The registered queries next to their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import database, difference
from conftest import SF_DIR

import __spark_entry__ as entry

QUICK = [
    "error_groups",
    "summary_cube",
    "services_per_group",
    "detect_anomalies",
    "compare_untruncated",
    "service_chain",
    "mask_text",
    "issue_preview",
    "normalize_documents",
    "fingerprint_message",
    "parse_ts_iso",
    "table_adapter",
    "line_number",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    frame = entry.queries()[name](spark, SF_DIR)
    assert difference(frame, database(SF_DIR), entry.oracle_sql()[name]) is None

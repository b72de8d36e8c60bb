"""Registered queries: contract, and a sample compared with SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
import oracle_check  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["case_tables", "transaction_features", "wallet_features", "temporal_links", "correlation_status", "network_signals"]
SPLIT = ["wallet_features", "network_features", "record_ids"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    assert oracle_check.compare(entry.queries()[name](spark, SF), oracle_check.connect(SF), entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", SPLIT)
def test_matches_sql_when_groups_are_cut(spark, name):
    spark.conf.set("spark.ledgerscope.splitRows", "60")
    try:
        assert oracle_check.compare(entry.queries()[name](spark, SF), oracle_check.connect(SF), entry.oracle_sql()[name]) == ""
    finally:
        spark.conf.unset("spark.ledgerscope.splitRows")

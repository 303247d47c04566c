"""Every checked query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from checks.compare import compare

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_agrees_with_sql(spark, name):
    ok, text, _ = compare(spark, SF_DIR, name)
    assert ok, text


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

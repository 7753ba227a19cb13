"""Every registered query gives the rows of its SQL check; the driver contract holds."""

import os

import pytest

import __spark_entry__ as entry
from fleetlens import catalog
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert name in entry.oracle_sql(), "a query without a check"
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["bundle_id", "level", "fingerprint", "count", "first_seen", "last_seen", "sample"]

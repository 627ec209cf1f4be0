"""Every query against its SQL on DuckDB, sf0.001."""

import os

import oracle
import pytest

from loomlog import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    want, got = oracle.compare(con, catalog.ORACLES[name], catalog.QUERIES[name](spark, SF))
    assert got == want


def test_names_agree():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

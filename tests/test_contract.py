"""Every registered query against its SQL, and the driver's entry points."""

import compare
import pytest
from conftest import SMALL

import __spark_entry__ as contract
from tidepost.catalog import ORACLES, QUERIES

ROWS_ONLY = set()
EMPTY_WHEN_SMALL = {"cancelled_jobs"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 20


def test_only_listed_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, SMALL))
    wanted_columns, wanted = compare.sql_rows(con, ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted
    assert rows or name in EMPTY_WHEN_SMALL

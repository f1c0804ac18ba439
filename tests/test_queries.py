"""Every named query against its SQL, on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module
from callcause.catalog.oracles import oracle_sql
from callcause.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_statement(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, oracle_sql()[name]) == []


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0

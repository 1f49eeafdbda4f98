"""Every registered query against its DuckDB statement."""

import pytest
from compare import duck_rows, oracle_connection, spark_rows

import __spark_entry__ as contract
from turnledger.catalog.ingest_queries import INGEST_QUERIES
from turnledger.catalog.queries import QUERIES as TABLE_QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = {**TABLE_QUERIES, **INGEST_QUERIES}, contract.oracle_sql()


def test_contract_registers_them():
    assert set(QUERIES) <= set(contract.queries())


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    oracle_names, oracle_rows = duck_rows(duck, ORACLES[name])
    assert names == oracle_names
    assert rows == oracle_rows

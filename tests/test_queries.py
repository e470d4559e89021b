import oracle
import pytest

import __spark_entry__ as contract
from lakesteward.plans.oracles import ORACLES
from lakesteward.plans.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, connection, name):
    names, rows = oracle.rows_of_frame(QUERIES[name](spark, sf_dir))
    expected_names, expected = oracle.rows_of_sql(connection, ORACLES[name])
    assert names == expected_names
    assert rows == expected


def test_flagship(spark):
    report = {r["tbl"]: r for r in contract.entry(spark).collect()}
    assert set(report) == {"customer", "orders", "lineitem"}
    assert all(r["n_before"] - r["n_after"] == r["n_deleted"] > 0 for r in report.values())

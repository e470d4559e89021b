import oracle
import pytest

import __spark_entry__ as contract
from lakesteward.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


def test_all_thirteen_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert QUERIES.items() <= contract.queries().items() and "pipeline" in contract.queries()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf_dir, connection, name):
    names, rows = oracle.rows_of_frame(QUERIES[name](spark, sf_dir))
    expected_names, expected = oracle.rows_of_sql(connection, ORACLES[name])
    assert names == expected_names
    assert rows == expected

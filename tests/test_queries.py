"""Every query of the library against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry_point
from workload import compare
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_entry(spark):
    found = entry_point.entry(spark)
    assert found.columns == ["sig_id", "zhang", "jnjs", "id", "smiles"]
    assert found.count() == 14


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry_point.queries().items()
    assert ORACLES.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, SF_DIR, name) == []

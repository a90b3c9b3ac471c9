"""Every registered query at the smallest scale against its SQL."""

import pytest
from oracle import compare, duck

import workload

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(workload.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, workload.QUERIES[name], workload.ORACLES[name], FOLDER) is None

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def distributed(spark):
    """Take every plan for too large to hold in one task."""
    spark.conf.set("spark.tablewise.inMemoryBytes", "0")
    yield
    spark.conf.unset("spark.tablewise.inMemoryBytes")

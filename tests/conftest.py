import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from panelcheck.session import local_session

    s = local_session(8, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def fx(spark, folder):
    from panelcheck.fixtures import Fixtures

    return Fixtures(spark, folder)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from flowgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "flowgauge-tests", "6g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def drop_cache(spark):
    yield
    spark.catalog.clearCache()

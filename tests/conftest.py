import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from codesieve.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def code(spark):
    """Files DataFrame from (path, language, content) rows."""
    def make(*rows):
        return spark.createDataFrame(list(rows), "path string, language string, content string")
    return make

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="6g", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """A (id, text) table from a list of texts."""

    def make(items):
        return spark.createDataFrame(list(enumerate(items)), "id long, text string")

    return make

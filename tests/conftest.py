import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stepwise.session import get_session
    s = get_session("local[4]", app="stepwise-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def tmpdir_spark(tmp_path):
    return str(tmp_path)

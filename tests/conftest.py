import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shiftcast.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=4, app="shiftcast-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shiftcast-test-", dir=os.environ.get("TMPDIR", "/tmp"))


def ts(s: str):
    import datetime as dt

    return dt.datetime.fromisoformat(s)

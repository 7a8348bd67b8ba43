import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cairnledger.session import local_session

    s = local_session(os.environ.get("TEST_CORES", "4"), "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    yield s
    s.stop()

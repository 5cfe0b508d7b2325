import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from loomrank.session import build_session

    session = build_session(cpus=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session

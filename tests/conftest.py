import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
# Python workers must import the test modules that define scorer classes.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, HERE] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])


@pytest.fixture(scope="session")
def spark():
    from litsift.session import get_session

    s = get_session(master="local[4]", shuffle_partitions=4, app_name="litsift-tests")
    yield s
    s.stop()

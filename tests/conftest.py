import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
# Python workers import the test modules that define completers / encoders
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, HERE] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])


@pytest.fixture(scope="session")
def spark():
    from bugsift.session import local_session
    s = local_session(4, app="bugsift-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bugsift-test-ckpt-", dir="/tmp")})
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"

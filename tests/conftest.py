import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cauce.session import build_session
    # tests only: a local folder as the shared one
    s = build_session("local[4]", 8, app_name="cauce-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="cauce-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL

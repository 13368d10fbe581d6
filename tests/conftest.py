import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from aeris.session import build_session, local_conf
    s = build_session("local[*]", "aeris-tests", local_conf(8, "8g"))
    yield s
    s.stop()

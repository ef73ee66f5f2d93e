import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loadscope.session import get_spark, shared_dir
    s = get_spark("local[4]", 8, app="loadscope-tests", driver_memory="8g")
    shared_dir(s)
    yield s
    s.stop()

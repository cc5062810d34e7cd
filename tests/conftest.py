import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import get_session

    s = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()

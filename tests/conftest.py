import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siltweave.session import clean, local_session, ship_package  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="4", partitions=4, memory="6g")
    ship_package(s)
    yield s
    clean(s)
    s.stop()

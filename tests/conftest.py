import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnscape.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TARNSCAPE_DRIVER_MEMORY", "6g")
    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    return s

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from orrery.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s

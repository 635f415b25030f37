import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as entry
    from tidemark.session import local_session

    s = local_session("tests", "*", 4)
    s.sparkContext.setLogLevel("OFF")
    entry._ship(s)
    yield s
    s.stop()

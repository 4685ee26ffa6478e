import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__  # noqa: F401  (ships the package with task functions)
    from signalbook.session import local_session

    s = local_session("tests")
    s.sparkContext.setLogLevel("ERROR")
    return s

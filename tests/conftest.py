import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from compare import spark_session

    session = spark_session()
    yield session
    session.stop()

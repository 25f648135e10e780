import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tunetable.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tunetable-tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()

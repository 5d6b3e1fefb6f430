import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.session import drop_written, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_written(session)
    session.stop()

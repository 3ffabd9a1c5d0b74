import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from caregap.session import local_session

    session = local_session(cpus=4, app="caregap-tests", shuffle_partitions=4)
    yield session
    session.stop()

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarrysift.session import local_session, share_code

    session = local_session(4, app="tests", driver_memory="4g", **{"spark.sql.shuffle.partitions": "4"})
    share_code(session)
    yield session
    session.stop()

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from marlpit.session import get_session

    session = get_session("tests", cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()

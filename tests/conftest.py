import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from checks.session import local_session
    from givetide.sources.warehouse import guard, release

    session = local_session(8, 4)
    guard(session)
    yield session
    release(session)
    session.stop()

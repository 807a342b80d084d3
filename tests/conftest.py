import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from stratiform.session import build

    session = build("local[4]", 4, spark__driver__memory="4g")
    yield session
    session.stop()

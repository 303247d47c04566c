import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from docketry.session import local_session  # noqa: E402
from docketry.streaming.limiter import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "docketry-tests", shuffle=4, memory="8g", **STATE_STORE)

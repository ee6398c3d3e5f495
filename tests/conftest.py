import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelforge.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)

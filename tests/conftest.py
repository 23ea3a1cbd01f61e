import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from lexloom.session import session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    ship_package(made)
    yield made
    made.stop()

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidekb.session import local_session, ship_package

    s = local_session("tests", "4", "6g")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import check

    return check.connect(SF)

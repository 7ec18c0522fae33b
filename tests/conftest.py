import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from framelake.session import get_spark
    s = get_spark("tests", cores="8", spark__sql__shuffle__partitions="8")
    yield s
    s.stop()

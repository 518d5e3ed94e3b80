import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from twinspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "3g", spark__sql__shuffle__partitions="4")

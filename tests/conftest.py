import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH", ""))))

import pytest

from quillstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "4g", spark__sql__shuffle__partitions="4")

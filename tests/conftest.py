import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from sifterra.session import local_session

    return local_session(4, "4g", "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"

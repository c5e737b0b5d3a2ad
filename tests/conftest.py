import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from passagework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plan():
    return lambda df: df._jdf.queryExecution().executedPlan().toString()

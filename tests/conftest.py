import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import compare  # noqa: E402  (also puts the repository on the path)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = compare.session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return compare.duck(SF_SMALL)

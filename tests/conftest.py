import pytest

from recordloom.session import local_session
from tests.oracle import duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return duck(FOLDER)

import pytest

from tidemill.session import session


@pytest.fixture(scope="session")
def spark():
    return session(8, app="tests")


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"

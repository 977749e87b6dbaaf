import pytest

from quern.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(4, 4, "4g")
    yield session
    session.stop()

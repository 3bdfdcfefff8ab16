import pytest

from sparkdemand.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    yield session
    session.stop()

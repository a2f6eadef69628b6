import pytest

from querytide.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "6g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["one chunk", "several chunks"])
def mode(request, monkeypatch):
    """Runs a test with ordered rows in one chunk and in several."""
    if request.param == "several chunks":
        monkeypatch.setattr("querytide.functions.ordered.CHUNK_ROWS", 3)
    yield request.param

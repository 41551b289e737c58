import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    yield local_session(memory="4g", partitions="4")

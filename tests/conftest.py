import pytest

from vereda import session


@pytest.fixture(scope="session")
def spark():
    s = session.local(4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

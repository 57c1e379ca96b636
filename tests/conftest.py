import pytest

from vouchline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "vouchline-tests", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

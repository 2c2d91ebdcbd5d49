import pytest

from scriptorium.session import local_spark


@pytest.fixture(scope="session")
def spark():
    s = local_spark(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

import pytest

from seqloom.session import build, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()

import pytest

from fundloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

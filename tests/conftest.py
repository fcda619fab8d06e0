import pytest

from glosswork import configure
from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    s = configure(session())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples in the given column order."""
    def collect(frame, *columns):
        picked = frame.select(*columns) if columns else frame
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect

"""One local session for all tests."""

import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted tuples of a frame, in the order of its columns or of those named."""

    def collect(frame, *columns):
        found = [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]
        return sorted(found, key=lambda r: tuple((x is not None, str(x)) for x in r))

    return collect


@pytest.fixture(scope="session")
def at():
    """A moment in UTC from text."""
    return lambda text: datetime.fromisoformat(text).replace(tzinfo=UTC)

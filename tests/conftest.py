import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vitalspan import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g")
    yield session
    session.stop()


def day(text):
    return date.fromisoformat(text)


def at(text):
    return datetime.fromisoformat(text)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

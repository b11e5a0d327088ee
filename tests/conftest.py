import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexforge.session import build_session

    session = build_session(4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def by_hand(rows):
    """Rows of a frame as sorted tuples."""
    return sorted(tuple(r) for r in rows.collect())

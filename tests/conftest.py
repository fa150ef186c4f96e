import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from obsynth.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, app="tests", memory="8g")
    yield s
    s.stop()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]

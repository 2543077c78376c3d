import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trafficlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "4g")


@pytest.fixture
def rows():
    """Collect a DataFrame as a list of dicts ordered by the given columns."""

    def run(df, *order):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple(r[o] for o in order)) if order else out

    return run

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quern.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores=4, partitions=4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})


@pytest.fixture
def rows():
    """Sorted plain tuples of a frame."""

    def get(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    return get

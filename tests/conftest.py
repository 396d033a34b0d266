import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weir.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("weir-tests", "8", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture
def folder():
    """A new folder below /tmp for each test."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows_of(df, *columns):
    """Rows as sorted tuples, NULLs last."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])

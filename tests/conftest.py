import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from blotter.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "blotter-tests")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Make a DataFrame from rows and a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)

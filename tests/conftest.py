from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyfold.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tallyfold.sources.mapped import MappedTables

    return MappedTables(spark, SMALL)


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def make(spark):
    """A DataFrame from a schema text and rows."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)

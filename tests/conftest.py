from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from adpulse.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="adpulse-tests", scratch=True)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adpulse-test-ckpt-"))
    yield s


@pytest.fixture()
def df(spark):
    """Build a DataFrame from rows and a DDL schema string."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from custlens.plans.session import build_session
    s = build_session("custlens-tests", cpus=4, shuffle_partitions=8, driver_memory="6g",
                      checkpoint_dir=tempfile.mkdtemp(prefix="custlens-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """Spark reads a cached frame wherever an equal plan stands, also in later modules that look at scans and at what is written."""
    yield
    from pyspark.sql import SparkSession
    if s := SparkSession.getActiveSession():
        s.catalog.clearCache()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="custlens-test-")

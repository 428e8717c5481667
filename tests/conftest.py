import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from stockmill.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.sql.maxMetadataStringLength": "1000"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not found")
    return SF_DIR


@pytest.fixture()
def fresh(spark):
    """A new path below the shared folder."""
    from stockmill.session import new_dir

    return new_dir(spark, "test")

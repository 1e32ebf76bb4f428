import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from headwater.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def make_scripts(spark, texts: dict):
    rows = [(f"mem:/{name}", name, txt) for name, txt in texts.items()]
    return spark.createDataFrame(rows, "path STRING, source_file STRING, txt STRING")

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from latticework import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", 8, **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        "spark.driver.memory": "6g", "spark.driver.extraJavaOptions": "-Xss8m"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

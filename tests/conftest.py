import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loadtide.session import build_session
    s = build_session("tests", "8", **{"spark.sql.shuffle.partitions": "4",
                                       "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def ts():
    from datetime import datetime
    return lambda text: datetime.fromisoformat(text)

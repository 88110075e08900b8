import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from strataweave.session import session

    s = session("local[8]", 2, spark__default__parallelism="2", spark__driver__memory="8g", spark__sql__warehouse__dir="/tmp/strataweave-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def engine(spark):
    from strataweave.engine import Engine

    return Engine(spark)

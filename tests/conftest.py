import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from voltlake.session import session

    s = session("local[8]", shuffle_partitions=8, **{"spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
